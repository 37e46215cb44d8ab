"""Ranges of delimited files against the whole file, cut at every byte."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.sources import exports, files

SAMPLES = [
    b'id,note\n1,"a\nb ""c"" , d"\n\n2,plain "quote" inside\n3,"x"y"z\n4,"two\n\nlines"\n',
    b'\xef\xbb\xbfid;name;city\r\n1;"M\xc3\xbcller; Anna";"K\xc3\xb6ln\r\n(Altstadt)"\r\n2;;\r\n;;\r\n3;a;b;c;d\r\n',
    b'a|b\n1|caf\xe9\n2|"open until\nthe end',
    b'a|b\n1|caf\xe9\n2|"open until\nthe end\n',
    b'"one\nheader","two"\n1,2\n',
    b"\n1,2\n", b" , \n1,2\n", b"", b"only\n", b'x\ty\n"\t\n"\t"\n"\n"""""\t"",\n', b"n,\x81\xe9\n1,2\n",
    b'"' + b"long\n" * 30 + b'",b\n1,2\n', b'a,"b',
]


def want(content):
    return [(row, cells, order) for _, row, _, cells, order in files.read_csv(content)]


def by_ranges(content, cuts):
    """What the two passes give without Spark: lines belong to the range in which they start."""
    bare = content.removeprefix(b"\xef\xbb\xbf") if files.decode(content) and content.startswith(b"\xef\xbb\xbf") else content
    lines, at, held = bare.split(b"\n"), 0, {}
    if not lines[-1]:
        lines.pop()
    for line in lines:
        held.setdefault(max(c for c in cuts if c <= at), []).append(line)
        at += len(line) + 1
    head = b"\n".join(lines[: exports.HEAD_LINES])
    text = files.decode(content)
    sep = files.delimiter(text).encode()
    ranges = []
    for start, own in held.items():
        r = exports.Range()
        for i in range(0, len(own), 2):
            r.add(own[i : i + 2], sep)
        ranges.append((start, r))
    encoding = exports.encoding_of(r for _, r in ranges)
    assert bare.decode(encoding) == text
    places, rows, pieces = exports.placed(ranges), {}, {}
    for start, own in held.items():
        for number, cells, piece in exports.parsed(iter(own), places[start], sep, encoding):
            if piece is None:
                assert number not in rows
                rows[number] = cells
            else:
                pieces.setdefault(number, []).append((start, piece))
    for number, own in pieces.items():
        text = b"\n".join(p for _, p in sorted(own)).split(b"\n")
        ((_, cells, _),) = exports.parsed(iter(text), exports.Place(0, False, False), sep, encoding)
        if not content.endswith(b"\n") and number == max([*rows, *pieces]) and max(places.items())[1].after:
            cells[-1] = cells[-1][:-1]
        rows[number] = cells
    assert sorted(rows) == list(range(len(rows))) and head is not None
    headers = files.headers_of(rows[0]) if rows else []
    return [(n, cells, list(dict.fromkeys(headers))) for n in range(1, len(rows)) if headers and (cells := files.grid_row(headers, rows[n])) is not None]


def test_every_cut():
    rng = random.Random(2)
    for content in SAMPLES:
        for a in range(0, len(content) + 1, 1 if len(content) < 120 else 7):
            assert by_ranges(content, [0, a]) == want(content), (content, a)
            for b in range(a, len(content) + 1, 3 if len(content) < 120 else 50):
                assert by_ranges(content, [0, a, b]) == want(content), (content, a, b)
    for _ in range(1500):
        content = b"a,b\n" + "".join(rng.choice(['"', '"', ",", "\n", "x", "é"]) for _ in range(rng.randrange(60))).encode()
        assert by_ranges(content, [0, *sorted(rng.randrange(len(content)) for _ in range(3))]) == want(content), content


@pytest.mark.parametrize("size", [1, 5, 17, 1000])
def test_read_in_ranges(spark, tmp_path, size):
    for i, content in enumerate(SAMPLES):
        (tmp_path / f"f {i} [ü].csv").write_bytes(content)
    (tmp_path / "x.json").write_text('[{"a": 1}]')
    rng = random.Random(size)
    long = 'k,v\n' + "".join(f'{i},"{rng.choice(["p", "q" + chr(10) + "r", "s,t", "u" * rng.randrange(40)])}"\n' for i in range(400))
    (tmp_path / "long.csv").write_text(long)
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    each = lambda df: sorted((r.asDict() for r in df.collect()), key=lambda r: r["record_id"])
    try:
        whole = each(files.read_records(spark, [str(tmp_path)], split_bytes=1 << 30))
        spark.conf.set(key, str(size * (40 if size < 1000 else 1)))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        split = files.read_records(spark, [str(tmp_path)], split_bytes=0)
        assert each(split) == whole and len(whole) > 400
        report = {r.file: (r.kind, r.rows) for r in files.file_report(spark, [str(tmp_path)], split_bytes=0).collect()}
        assert report["long.csv"] == ("csv", 400) and report["x.json"] == ("json", 1)
    finally:
        spark.conf.set(key, old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_cells_and_bad_files(spark, tmp_path):
    (tmp_path / "wide.csv").write_text('a,b\n1,"' + "x" * 300_000 + '"\n')
    got = files.read_records(spark, [str(tmp_path)], split_bytes=0).select(F.length(F.element_at("cells", F.lit("b"))).alias("n")).collect()
    assert [r.n for r in got] == [300_000]
    (tmp_path / "bad.csv").write_bytes(b"a,b\n1,x\ry\n")
    assert [r.note[:6] for r in files.file_report(spark, [str(tmp_path / "bad.csv")]).collect()] == ["the fi"]
    with pytest.raises(Exception, match=r"bad\.csv"):
        files.read_records(spark, [str(tmp_path / "bad.csv")], split_bytes=0).count()
