"""Conversation structure repair: the cheapest edits that give a conversation alternating turns, by A* over the lattice of edits."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import SPACES, hot_keys, materialize, read_table, small_batches, spread_join

#: Costs of edits; a truncated turn that stays costs TRUNCATED more.
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
#: Faults of a turn; the first two demand that it goes.
NONE, BLANK, DUPLICATE, CUT = range(4)
#: What the repaired turns so far end in.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state that an inserted turn, or one with a new role, leads to, and its role.
DUE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that close a conversation that ends in a state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Turns that one search takes at most: its keys hold audits, so longer conversations are searched in chunks whose results are composed.
CHUNK = 256
#: A conversation of more turns or characters is repaired by chunks in many tasks; a shorter one in one task.
LONG_TURNS, LONG_CHARS = 4096, 1 << 24

Exits = dict[int, tuple[int, str]]


def search(turns: list[tuple[str, int]], start: int, last: bool) -> Exits:
    """For each state in which turns (initial of the role, fault) can be left from start: the least cost, and the ASCII-least audit of that cost.

    A* with keys (cost + bound, audit): the bound is the suffix sum of deletions that faults demand and of charges for
    truncated turns, which no edit avoids for less. It never falls along an edge by more than the edge costs, so a node
    is settled when it is first taken. Two audits of equal cost at one node are never prefixes of one another, so the lesser one
    stays lesser whatever follows. last: only the first closed state (nothing, or a whole pair) counts, and inserts may
    close it; otherwise every audit ends with a turn of the input.
    """
    n = len(turns)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = turns[i][1]
        ahead[i] = ahead[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT else 0)
    heap: list[tuple[int, str, int, int]] = [(ahead[0], "", 0, start)]
    settled: set[tuple[int, int]] = set()
    exits: Exits = {}
    while heap:
        bound, audit, i, at = heappop(heap)
        if (i, at) in settled:
            continue
        settled.add((i, at))
        if i == n and (not last or not CLOSING[at]):
            exits[at] = (bound, audit)
            if last:
                break
            continue
        cost, due = bound - ahead[i], DUE[at]
        heappush(heap, (bound + INSERT, audit + "I", i, due))
        if i == n:
            continue
        initial, fault = turns[i]
        rest = cost + ahead[i + 1]
        heappush(heap, (rest + DELETE, audit + "D", i + 1, at))
        if fault in (BLANK, DUPLICATE):
            continue
        rest += TRUNCATED * (fault == CUT)
        if initial in NEXT[at]:
            heappush(heap, (rest, audit + "K", i + 1, NEXT[at][initial]))
        heappush(heap, (rest + REROLE, audit + "R", i + 1, due))
    return exits


def matrix(turns: list[tuple[str, int]]) -> dict[int, Exits]:
    """Exits of one chunk from every state."""
    return {start: search(turns, start, False) for start in DUE}


def ranked(exits: Exits) -> dict[int, tuple[int, int]]:
    """Exits with the rank of their audits instead of the audits: all that composition compares."""
    order = sorted({audit for _, audit in exits.values()})
    return {at: (cost, order.index(audit)) for at, (cost, audit) in exits.items()}


def best_path(chunks: list[dict[int, dict[int, tuple[int, int]]]]) -> list[tuple[int, int]]:
    """(start, end) of each chunk on the cheapest way through all, ties to the ASCII-least audit; chunks: start to end to (cost, rank among the audits from start)."""
    reached, back = {START: (0, 0)}, []
    for chunk in chunks:
        best: dict[int, tuple[tuple[int, int, int], int]] = {}
        for start, (cost, order) in reached.items():
            for end, (more, rank) in chunk[start].items():
                key = (cost + more, order, rank)
                if end not in best or key < best[end][0]:
                    best[end] = (key, start)
        orders = sorted({key[1:] for key, _ in best.values()})
        reached = {end: (key[0], orders.index(key[1:])) for end, (key, _) in best.items()}
        back.append({end: start for end, (_, start) in best.items()})
    at = min(reached, key=lambda s: (reached[s][0] + INSERT * CLOSING[s], reached[s][1]))
    path = []
    for step in reversed(back):
        path.append((step[at], at))
        at = step[at]
    return path[::-1]


def audit_of(turns: list[tuple[str, int]]) -> list[str]:
    """The audit of each chunk of a whole conversation."""
    if len(turns) <= CHUNK:
        return [next(iter(search(turns, START, True).values()))[1]]
    chunks = [matrix(turns[i : i + CHUNK]) for i in range(0, len(turns), CHUNK)]
    path = best_path([{start: ranked(exits) for start, exits in chunk.items()} for chunk in chunks])
    audits = [chunk[start][end][1] for chunk, (start, end) in zip(chunks, path, strict=True)]
    return [*audits[:-1], audits[-1] + "I" * CLOSING[path[-1][1]]]


#: One row for each edit, in order: turn and was are the input's turn and role (null for an insert), fault the input's, edit one of
#: K, R, D, I, times how often it is made in a row, charge the cost of one, role and text those of the repaired turn (null for D). A conversation without turns has one row of nulls.
EDIT = "turn long, was string, fault int, edit string, times long, charge int, role string, text string"
Turn = tuple[int | None, str, str, int, int]


def edits_of(turns: list[Turn], audit: str, state: int) -> Iterator[tuple]:
    """Rows of EDIT for turns (turn, role, text, fault, copies) and their audit from state; further copies of a turn are repeats, and go."""
    at = iter(turns)
    for edit in audit:
        if edit == "I":
            state = DUE[state]
            yield None, None, NONE, "I", 1, INSERT, ROLES[state], ""
            continue
        turn, role, text, fault, copies = next(at)
        held = TRUNCATED * (fault == CUT)
        if edit == "D":
            yield turn, role, fault, "D", 1, DELETE, None, None
        elif edit == "K":
            state = NEXT[state][role[:1]]
            yield turn, role, fault, "K", 1, held, role, text
        else:
            state = DUE[state]
            yield turn, role, fault, "R", 1, held + REROLE, ROLES[state], text
        if copies > 1:
            yield turn, role, fault if fault == BLANK else DUPLICATE, "D", copies - 1, DELETE, None, None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations of sorted rows, across batches: the id, and its rows; a reader need not hold them."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row = next(rows, None)

    def own(key):
        nonlocal row
        while row is not None and row["_c"] == key:
            yield row
            row = next(rows, None)

    while row is not None:
        key, conv = row["_c"], row["conv_id"]
        yield (key, conv), own(key)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_EDIT_ARROW = pa.schema(
    [("turn", pa.int64()), ("was", pa.string()), ("fault", pa.int32()), ("edit", pa.string()), ("times", pa.int64()), ("charge", pa.int32()), ("role", pa.string()), ("text", pa.string())]
)


def _repaired(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole short conversations, sorted: one at a time is held."""
    schema = pa.schema([("_c", pa.string()), ("conv_id", kind), *_EDIT_ARROW])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, own in _runs(batches):
            seen: set[tuple[str, str]] = set()
            turns: list[Turn] = []
            for r in own:
                if r["_copies"] <= 0:
                    continue
                said = (r["role"], r["text"])
                turns.append((r["turn"], *said, DUPLICATE if r["_fault"] != BLANK and said in seen else r["_fault"], r["_copies"]))
                seen.add(said)
            if not turns:
                yield *key, None, None, NONE, None, 0, 0, None, None
            for edit in edits_of(turns, "".join(audit_of([(t[1][:1], t[3]) for t in turns])), START):
                yield *key, *edit

    return lambda batches: _in_batches(rows(batches), schema)


def _matrices(table: pa.Table) -> pa.Table:
    """Costs and ranks of one chunk of a long conversation: 16 rows at most."""
    table = table.sort_by("_at")
    out = [(s, e, c, r) for s, exits in matrix(list(zip(table["_initial"].to_pylist(), table["_fault"].to_pylist()))).items() for e, (c, r) in ranked(exits).items()]
    key = [table[c][0].as_py() for c in ("_c", "_chunk")]
    return pa.table([pa.array([key[0]] * len(out), pa.string()), pa.array([key[1]] * len(out), pa.int64()), *(pa.array(x, pa.int32()) for x in zip(*out))], names=["_c", "_chunk", "_start", "_end", "_cost", "_rank"])


def _paths(table: pa.Table) -> pa.Table:
    """The way through one long conversation, from the matrices of its chunks: 16 small numbers for CHUNK turns."""
    chunks: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
    for r in table.sort_by("_chunk").to_pylist():
        chunks.setdefault(r["_chunk"], {}).setdefault(r["_start"], {})[r["_end"]] = (r["_cost"], r["_rank"])
    path = best_path(list(chunks.values()))
    close = [0] * (len(path) - 1) + [CLOSING[path[-1][1]]]
    own = pa.array([table["_c"][0].as_py()] * len(path), pa.string())
    return pa.table([own, pa.array(list(chunks), pa.int64()), *(pa.array(x, pa.int32()) for x in (*zip(*path), close))], names=["_c", "_chunk", "_start", "_end", "_close"])


def _applied(kind: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Edits of one chunk of a long conversation, its way being known."""
    schema = pa.schema([("_c", pa.string()), ("conv_id", kind), *_EDIT_ARROW, ("_chunk", pa.int64()), ("_k", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("_at").to_pylist()
        head = rows[0]
        audit = search([(r["_initial"], r["_fault"]) for r in rows], head["_start"], False)[head["_end"]][1] + "I" * head["_close"]
        turns = [(r["turn"], r["role"], r["text"], r["_fault"], r["_copies"]) for r in rows]
        out = [(head["_c"], head["conv_id"], *e, head["_chunk"], k) for k, e in enumerate(edits_of(turns, audit, head["_start"]))]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def edits(turns: DataFrame, copies: Column | None = None, long_turns: int = LONG_TURNS, long_chars: int = LONG_CHARS) -> DataFrame:
    """The edits that repair each conversation: _c, conv_id and the columns of EDIT, in order within a partition that holds whole conversations.

    turns has conv_id, turn (long), role and text; a row counts copies times in a row (once by default; 0: only its conversation does).
    A null role or text is one space; a null conv_id is a conversation, a null turn comes first; equal turns are in the order of role and
    text. The repaired roles begin with the initials (s?(ua)+)?. An empty table gives none; other columns are ignored.

    Conversations of up to long_turns turns and long_chars characters are shuffled once and repaired one at a time. Longer ones are dealt out
    by ranges of their turns: repeats are found by their first turn in a join, each chunk is searched from all four states, the matrices are composed, and the chunks
    on the cheapest way are searched once more for their edits; the result is the same.
    """
    trimmed = F.rtrim("text", F.lit(SPACES))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("_c"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("_copies"),
    ).withColumn("_fault", F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), NONE).otherwise(CUT))
    sizes = rows.groupBy("_c").agg(F.count_if(F.col("_copies") > 0).alias("_n"), F.sum(F.length("text")).alias("_size"))
    long = materialize(sizes.where((F.col("_n") > long_turns) | (F.col("_size") > long_chars)).select("_c"), "long-conversations")
    kind = _arrow_type(rows, "conv_id")
    any_long = not long.isEmpty()
    order = ["_c", "turn", "role", "text"]
    short = rows.join(long, "_c", "left_anti") if any_long else rows
    found = _streamed(short.repartition("_c").sortWithinPartitions(*order), _repaired(kind), f"_c string, conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDIT}")
    return found.unionByName(_long_edits(rows.join(long, "_c", "left_semi"), kind)) if any_long else found


def _streamed(df: DataFrame, run, schema: str) -> DataFrame:
    return small_batches(df).mapInArrow(run, schema)


def _long_edits(rows: DataFrame, kind: pa.DataType) -> DataFrame:
    once = rows.where("_copies > 0").groupBy("_c", "conv_id", "turn", "role", "text", "_fault").agg(F.sum("_copies").alias("_copies"))
    once = once.withColumn("_said", F.sha2(F.to_json(F.struct("_c", "role", "text")), 256)).withColumn("_when", F.struct(F.col("turn").isNotNull(), "turn"))
    once = materialize(once, "long-turns")
    first = once.groupBy("_said").agg(F.min("_when").alias("_first"))
    marked = spread_join(once, first, "_said", "turn", hot_keys(once, "_said"))
    marked = marked.withColumn("_fault", F.when((F.col("_fault") != BLANK) & ~F.col("_when").eqNullSafe(F.col("_first")), DUPLICATE).otherwise(F.col("_fault")))
    order = ["_c", "turn", "role", "text"]
    # Ids rise with the partition and within it, and partitions are ranges of the order, so ids follow the order; a partition's first id is a multiple of CHUNK.
    placed = marked.drop("_said", "_when", "_first").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("_chunk", F.expr(f"_at div {CHUNK}")).withColumn("_initial", F.left("role", F.lit(1))), "long-chunks")
    step = "_c string, _chunk long, _start int, _end int, "
    matrices = placed.select("_c", "_chunk", "_at", "_initial", "_fault").groupBy("_c", "_chunk").applyInArrow(_matrices, step + "_cost int, _rank int")
    paths = matrices.groupBy("_c").applyInArrow(_paths, step + "_close int")
    schema = f"_c string, conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDIT}, _chunk long, _k int"
    done = placed.join(paths, ["_c", "_chunk"]).groupBy("_c", "_chunk").applyInArrow(_applied(kind), schema)
    return done.repartition("_c").sortWithinPartitions("_c", "_chunk", "_k").drop("_chunk", "_k")


def reports(edits: DataFrame) -> DataFrame:
    """One row for each conversation of edits(): conv_id, gaps in its turns, blank, duplicate, truncated, illegal (neighbours whose roles' initials may not follow), cost, audit, repaired_sha256 of its repaired role:text lines.

    The digest takes the repaired turns one after the other, so a conversation streams through one task; only its audit and running sums are held.
    """
    kind = _arrow_type(edits, "conv_id")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (_, conv), own in _runs(batches):
            faults, audit, digest = [0] * 4, [], hashlib.sha256()
            illegal = cost = distinct = 0
            least = most = was = None
            joint = b""
            for r in own:
                if r["edit"] is None:
                    continue
                audit.append(r["edit"] * r["times"])
                cost += r["charge"] * r["times"]
                if r["role"] is not None:
                    digest.update(joint + f"{r['role']}:{r['text']}".encode())
                    joint = b"\n"
                if r["edit"] == "I":
                    continue
                faults[r["fault"]] += r["times"]
                initial = r["was"][:1]
                illegal += (was is not None and was + initial not in ("su", "ua", "au")) + r["times"] - 1
                was = initial
                if r["turn"] is not None and r["turn"] != most:
                    least, most, distinct = r["turn"] if least is None else least, r["turn"], distinct + 1
            gaps = most - least + 1 - distinct if distinct else 0
            yield conv, gaps, faults[BLANK], faults[DUPLICATE], faults[CUT], illegal, cost, "".join(audit), digest.hexdigest()

    out = f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"
    return _streamed(edits, lambda batches: _in_batches(rows(batches), schema), out)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the checksum of conv_id:turn, then repaired."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(name.cast("binary")) % 20
    damaged = turns.withColumn("_harm", harm).select(
        "conv_id", "turn", F.when(F.col("_harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_harm") == 1, "").when(F.col("_harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_harm") == 0, 0).when(F.col("_harm") == 3, 2).otherwise(1).alias("times"),
    )
    return reports(edits(damaged, F.col("times")))


#: Bytes of CRC-32 are folded by its polynomial; the cheapest edits come turn by turn as the least (cost, audit) of each state, without a search.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(t[((xor(c, x)) & 255) + 1], c >> 8)), 4294967295) % 20 AS harm FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM harmed)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
  SELECT *, role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
), turns AS (
  SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS bad, (fault = 'truncated')::INT AS cut FROM judged
), ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {'c': 0, 'a': ''} AS v0, NULL::STRUCT(c INT, a VARCHAR) AS vs, NULL::STRUCT(c INT, a VARCHAR) AS vu, NULL::STRUCT(c INT, a VARCHAR) AS va FROM conversations
  UNION ALL
  SELECT conv_id, i, list_min([{'c': v0.c + 3, 'a': v0.a || 'D'}]),
    list_min(list_filter([{'c': vs.c + 3, 'a': vs.a || 'D'}, CASE WHEN NOT bad AND r = 's' THEN {'c': v0.c + cut, 'a': v0.a || 'K'} END], lambda x: x.c IS NOT NULL)),
    list_min(list_filter([{'c': wu.c + 3, 'a': wu.a || 'D'}, CASE WHEN NOT bad THEN {'c': due.c + cut + (CASE WHEN r = 'u' THEN 0 ELSE 2 END), 'a': due.a || (CASE WHEN r = 'u' THEN 'K' ELSE 'R' END)} END], lambda x: x.c IS NOT NULL)),
    list_min(list_filter([{'c': wa.c + 3, 'a': wa.a || 'D'}, CASE WHEN NOT bad THEN {'c': wu.c + cut + (CASE WHEN r = 'a' THEN 0 ELSE 2 END), 'a': wu.a || (CASE WHEN r = 'a' THEN 'K' ELSE 'R' END)} END], lambda x: x.c IS NOT NULL))
  FROM (
    SELECT w.conv_id, t.i, r, bad, cut, v0, vs, wu, list_min(list_filter([va, {'c': wu.c + 2, 'a': wu.a || 'I'}], lambda x: x.c IS NOT NULL)) AS wa,
      list_min(list_filter([v0, vs, va, {'c': vu.c + 2, 'a': vu.a || 'I'}], lambda x: x.c IS NOT NULL)) AS due
    FROM (
      SELECT *, list_min(list_filter([vu, {'c': v0.c + 2, 'a': v0.a || 'I'}, {'c': vs.c + 2, 'a': vs.a || 'I'}, {'c': va.c + 2, 'a': va.a || 'I'}], lambda x: x.c IS NOT NULL)) AS wu FROM ways
    ) w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
  ) AS step(conv_id, i, r, bad, cut, v0, vs, wu, wa, due)
), best AS (
  SELECT conv_id, list_min(list_filter([v0, va, {'c': vu.c + 2, 'a': vu.a || 'I'}, {'c': vs.c + 4, 'a': vs.a || 'II'}], lambda x: x.c IS NOT NULL)) AS w
  FROM (SELECT *, i = max(i) OVER (PARTITION BY conv_id) AS is_last FROM ways) WHERE is_last
), letters AS (
  SELECT conv_id, p, w.a[p] AS e, sum((w.a[p] <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS i, sum((w.a[p] <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS o
  FROM (SELECT *, unnest(range(1, length(w.a) + 1)) AS p FROM best)
), outs AS (
  SELECT l.*, j.role, j.text, max((o = 1 AND e = 'K' AND r = 's')::INT) OVER (PARTITION BY l.conv_id) AS lead FROM letters l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i WHERE e <> 'D'
), lines AS (
  SELECT conv_id, string_agg(concat(CASE WHEN e = 'K' THEN role WHEN (o - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN e = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS x FROM outs GROUP BY conv_id
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND concat(before, r) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.w.c::BIGINT AS cost, b.w.a AS audit, sha256(coalesce(x, '')) AS repaired_sha256
FROM best b LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id
"""
