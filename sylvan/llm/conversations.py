"""Repair of conversations' turn structure by a backward cost-to-go over turns and grammar states.

A repaired conversation's roles follow ``(s?(ua)+)?`` in initials.  Its states are START (nothing yet), AFTER_S, AFTER_U and AFTER_A; START and
AFTER_A may end.  Each state can be left by one of u and a only, so that an edit names its result: Keep (0), Rerole (1), Delete
(2), Insert (5), and 5 more for a truncated turn that stays.  Blank and repeated turns must go.

The costs from each turn and state to the end are found backwards; a forward walk then takes, of the edits on which the cost is tight, the ASCII-least
initial (D < I < K < R).  As edits lead to one state each, that walk gives the least string of all cheapest ones.

Conversations are dealt out by id and sorted; a task handles one at a time.  One with more than ``long`` turns is cut into segments of
that many.  A turn is then a code of one byte; a segment's costs are a 4 x 4 matrix (min, +), so that what lies behind a segment is known from matrices
alone, and the state in which each segment is entered from the walks through the others.  Its lines are hashed as a stream: SHA-256 of one
text has no parts.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, map_batches, materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state after the role that a state asks for, and that role; START may take a kept s besides.
NEXT, ASKED = (AFTER_U, AFTER_U, AFTER_A, AFTER_U), ("user", "user", "assistant", "user")
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
#: Turns of a conversation that are handled at once.
LONG = 50_000

# A turn's code: initial (0 other, 1 s, 2 u, 3 a) + 4 * (0 whole, 1 truncated, 2 must go).
MUST_GO = 8


def kept(state: int, initial: int) -> int:
    """The state after a kept turn; -1 where the grammar bars it."""
    if state == START and initial == 1:
        return AFTER_S
    return NEXT[state] if initial == (3 if state == AFTER_U else 2) else -1


def before(code: int, after: Iterable[int]) -> tuple[int, int, int, int]:
    """Costs to the end from each state in front of a turn, from those behind it."""
    after, extra = tuple(after), TRUNCATED if code & 4 else 0
    cost = [DELETE + after[s] for s in range(4)]
    if code < MUST_GO:
        for s in range(4):
            cost[s] = min(cost[s], REROLE + extra + after[NEXT[s]])
            t = kept(s, code & 3)
            if t >= 0:
                cost[s] = min(cost[s], KEEP + extra + after[t])
    for s in (AFTER_U, AFTER_A, AFTER_U, START, AFTER_S):  # an insertion leads on; after u and a it may take two
        cost[s] = min(cost[s], INSERT + cost[NEXT[s]])
    return tuple(cost)


def costs(codes: bytes, end: Iterable[int] = END) -> list[tuple[int, int, int, int]]:
    """Costs to the end in front of each turn, and behind the last."""
    out = [tuple(end)]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def walk(codes: bytes, cost: list[tuple[int, int, int, int]], state: int, last: bool = True) -> tuple[list[str], int]:
    """For each turn its edit's initial behind those of insertions before it, and if ``last`` the insertions at the end; the state in the end."""
    out = []
    for i, code in enumerate(codes):
        edits = ""
        while True:
            now, after, extra = cost[i][state], cost[i + 1], TRUNCATED if code & 4 else 0
            stays = kept(state, code & 3) if code < MUST_GO else -1
            if now == DELETE + after[state]:
                edits += "D"
            elif now == INSERT + cost[i][NEXT[state]]:
                edits += "I"
                state = NEXT[state]
                continue
            elif stays >= 0 and now == KEEP + extra + after[stays]:
                edits, state = edits + "K", stays
            else:
                edits, state = edits + "R", NEXT[state]
            break
        out.append(edits)
    if last:
        edits = ""
        while END[state]:
            edits, state = edits + "I", NEXT[state]
        out.append(edits)
    return out, state


def lines(edits: str, state: int, role: str | None, text: str | None) -> tuple[list[str], int]:
    """The repaired lines that a turn's edits leave, and the state after them."""
    out = []
    for e in edits:
        if e == "D":
            continue
        if e == "K":
            out.append(f"{role}:{text}")
            state = kept(state, " sua".index(role[0]))
        else:
            out.append(f"{ASKED[state]}:{text if e == 'R' else ''}")
            state = NEXT[state]
    return out, state


def illegal_pairs(initials: bytes) -> int:
    """Neighbours that are not su, ua or au, of initials as in codes."""
    return sum((a, b) not in ((1, 2), (2, 3), (3, 2)) for a, b in itertools.pairwise(c & 3 for c in initials))


def damaged(talks: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, gone): the turns after damage by crc32 of ``conv_id:turn`` modulo 20; dropped ones are gone, but there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(id_col), F.lit(":"), blank(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank(text_col), "[.!?]", "")).otherwise(blank(text_col))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank(role_col))
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = talks.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), times.alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "gone", F.explode("times").alias("nth")).drop("nth")


def turn_code(role: Column, text: Column) -> Column:
    """A turn's code but for repetition: blank turns must go, truncated ones are marked."""
    initial = F.substring(role, 1, 1)
    letter = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    ends = text.rlike(rf"[.!?]{SPACE}*\z")
    return letter + F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 4 * 2 + 4 * 4).when(~ends, 4).otherwise(0)  # 16 marks blank


BLANK = 16
ORDER = ["conv_id", "turn", "role", "text"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIELDS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def repair(turns: list[tuple]) -> tuple:
    """The result but for the id, of a conversation's (turn, role, text, code) in order."""
    seen, codes, faults = set(), bytearray(), [0, 0, 0]
    for _, role, text, code in turns:
        again = (role, text) in seen
        seen.add((role, text))
        fault = 0 if code >= BLANK else 1 if again else 2 if code & 4 else None
        if fault is not None:
            faults[fault] += 1
        codes.append((code & 3) + MUST_GO if code >= BLANK or again else code)
    cost = costs(codes)
    edits, _ = walk(codes, cost, START)
    out, state = [], START
    for own, (_, role, text, _) in itertools.zip_longest(edits, turns, fillvalue=(None,) * 4):
        more, state = lines(own, state, role, text)
        out += more
    return _gaps([t for t, *_ in turns if t is not None]), *faults, illegal_pairs(codes), cost[0][START], "".join(edits), hashlib.sha256("\n".join(out).encode()).hexdigest()


def _dealt(rows: DataFrame) -> DataFrame:
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(*order)


def _repaired(rows: DataFrame) -> DataFrame:
    """RESULT of coded turns, a conversation at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        out = []
        for conv, own in itertools.groupby(turns, lambda r: r[0]):
            out.append((conv, *repair([r[1:5] for r in own if not r[5]])))
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FIELDS, strict=True)], schema=FIELDS)

    return map_batches(_dealt(rows).select("conv_id", "turn", "role", "text", "code", "gone"), run, RESULT)


# --- conversations with more turns than a task handles at once


def _matrix(codes: bytes) -> list[int]:
    """Least costs through a segment: from state s in front of it to t behind it at 4 * s + t."""
    columns = [costs(codes, [0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
    return [min(FAR, columns[t][s]) for s in range(4) for t in range(4)]


def _through(matrix: list[int], after: tuple) -> tuple:
    return tuple(min(matrix[4 * s + t] + after[t] for t in range(4)) for s in range(4))


SEGMENT = "conv_id long, seg long, codes binary, matrix array<long>"


def _segments(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(numbered turns with codes that know repetitions, segments of codes with their matrices)."""
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    spread = rows.withColumn("row", F.monotonically_increasing_id())  # equal turns needn't stay together
    parts = materialise(spread.repartitionByRange(*order, "row").withColumn("part", F.spark_partition_id()), "turns")
    ends = parts.groupBy("conv_id", "part").count()
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = ends.select(F.col("conv_id").alias("of"), F.col("part").alias("of_part"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order, "row"))
    turns = parts.withColumn("own", own).join(bases, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    turns = turns.select("conv_id", "turn", "role", "text", "code", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"), (F.col("base") + F.col("own") - 1).alias("nth"))
    turns = materialise(turns, "numbered")
    first = turns.groupBy(F.col("conv_id").alias("of"), F.col("said").alias("of_said")).agg(F.min("nth").alias("first"))
    told = turns.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("of_said")))
    told = told.select("conv_id", "nth", F.floor(F.col("nth") / size).alias("seg"), "turn", "role", "text", "code", (F.col("nth") > F.col("first")).alias("again"))
    told = materialise(told, "coded")
    byte = F.when((F.col("code") >= BLANK) | F.col("again"), F.col("code").bitwiseAND(3) + MUST_GO).otherwise(F.col("code"))
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", byte.alias("byte")))), lambda x: F.lpad(F.hex(x["byte"]), 2, "0")), "")
    codes = told.groupBy("conv_id", "seg").agg(F.unhex(hexes).alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            matrix = [_matrix(c.as_py()) for c in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(matrix, pa.list_(pa.int64()))], ["conv_id", "seg", "codes", "matrix"])

    return told, materialise(map_batches(codes.select("conv_id", "seg", "codes"), run, SEGMENT), "segments")


def _per_conversation(segments: DataFrame, column: str, fold, schema: str, names: list[str]) -> DataFrame:
    """fold(list of a conversation's (seg, column) in order) gives rows behind the id; a conversation has a row for each ``long`` turns here."""
    lists = segments.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", column))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, every in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seg, value = zip(*fold([(x["seg"], x[column]) for x in every]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(seg), pa.int64()), pa.array(seg, pa.int64()), pa.array(value, pa.list_(pa.int64()) if isinstance(value[0], list) else pa.int64())], names)

    return map_batches(lists, run, schema)


def _long(rows: DataFrame, size: int) -> DataFrame:
    """RESULT of coded turns, in segments; gone turns are left out, and each conversation here has others."""
    told, segments = _segments(rows, size)

    def behind(every):
        out, after = [], END
        for seg, matrix in reversed(every):
            out.append((seg, list(after)))
            after = _through(matrix, after)
        return out

    def entered(every):
        out, state = [], START
        for seg, exits in every:
            out.append((seg, state))
            state = exits[state]
        return out

    def met(df: DataFrame, few: DataFrame) -> DataFrame:
        few = few.withColumnsRenamed({"conv_id": "of", "seg": "of_seg"})
        return df.join(few, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seg") == F.col("of_seg"))).drop("of", "of_seg")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for codes, after in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                cost = costs(codes, after)
                found.append([walk(codes, cost, s, False)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], ["conv_id", "seg", "codes", "after", "exits"])

    ahead = _per_conversation(segments, "matrix", behind, "conv_id long, seg long, after array<long>", ["conv_id", "seg", "after"])
    segments = materialise(map_batches(met(segments.drop("matrix"), ahead).select("conv_id", "seg", "codes", "after"), exits, "conv_id long, seg long, codes binary, after array<long>, exits array<long>"), "exits")
    entry = _per_conversation(segments, "exits", entered, "conv_id long, seg long, state long", ["conv_id", "seg", "state"])
    last = segments.groupBy(F.col("conv_id").alias("of")).agg(F.max("seg").alias("last"))
    segments = met(segments, entry).join(last, F.col("conv_id").eqNullSafe(F.col("of")))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "nth", "edits", "state", "cost"]
        for b in batches:
            for conv, seg, codes, after, state, last_seg in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cost = costs(codes, after)
                own, _ = walk(codes, cost, state, seg == last_seg)
                states = []
                for e in own:
                    states.append(state)
                    state = walked(e, state, codes[len(states) - 1] if len(states) <= len(codes) else 0)
                n = len(own)
                nth = np.arange(seg * size, seg * size + n)  # the insertions at the end are a turn beyond the last
                yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array(nth), pa.array(own), pa.array(states, pa.int64()), pa.array([cost[0][START] if seg == 0 else None] + [None] * (n - 1), pa.int64())], names)

    each = materialise(map_batches(segments.select("conv_id", "seg", "codes", "after", "state", "last"), edits, "conv_id long, nth long, edits string, state long, cost long"), "edits")
    both = each.withColumnsRenamed({"conv_id": "of", "nth": "of_nth"}).join(told, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("nth") == F.col("of_nth")), "left")
    stream = both.select(F.col("of").alias("conv_id"), F.col("of_nth").alias("nth"), "edits", "state", "role", "text", "code").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "nth")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for conv, own in itertools.groupby(turns, lambda r: r[0]):
            sha, audit, some, illegal, earlier = hashlib.sha256(), [], False, 0, b""
            for _, _, edit, state, role, text, code in own:
                for line in lines(edit, state, role, text)[0]:
                    sha.update((("\n" if some else "") + line).encode())
                    some = True
                audit.append(edit)
                if code is not None:
                    illegal += illegal_pairs(earlier + bytes([code & 3]))
                    earlier = bytes([code & 3])
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "illegal": pa.array([illegal]), "audit": ["".join(audit)], "repaired_sha256": [sha.hexdigest()]})

    hashed = map_batches(stream, digests, "conv_id long, illegal long, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "of")
    blank, again = F.col("code") >= BLANK, F.col("again")
    sums = told.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), F.count_if(blank).alias("blank"), F.count_if(~blank & again).alias("duplicate"),
        F.count_if(~blank & ~again & (F.col("code").bitwiseAND(4) > 0)).alias("truncated"))
    price = each.filter("cost IS NOT NULL").select(F.col("conv_id").alias("of_price"), "cost")
    out = sums.join(hashed, F.col("conv_id").eqNullSafe(F.col("of"))).join(price, F.col("conv_id").eqNullSafe(F.col("of_price")))
    return out.select(*FIELDS.names)


def walked(edits: str, state: int, code: int) -> int:
    """The state after a turn's edits."""
    for e in edits:
        if e != "D":
            state = kept(state, code & 3) if e == "K" else NEXT[state]
    return state


def repair_conversations(turns: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Gone turns count for nothing; a conversation of them alone is empty.  Nulls: a null id is a conversation of its own, null turns come first, role and text
    have none (``damaged`` puts a space).  Equal turns: in order of role and text.  Repeated rows: duplicates.  Very long texts: read whole.  Empty table: no
    rows.  Further columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", turn_code(F.col("role"), F.col("text")).cast("int").alias("code"), "gone")
    sizes = turns.filter("NOT gone").groupBy(F.col("conv_id").cast("long").alias("of")).count().filter(F.col("count") > long).select("of")
    large = materialise(sizes, "long")
    if large.isEmpty():
        return _repaired(rows)
    within = F.col("conv_id").eqNullSafe(F.col("of"))
    return _repaired(rows.join(large, within, "left_anti")).unionByName(_long(rows.filter("NOT gone").join(large, within, "left_semi"), long))


def op13_conversations(spark, sf_dir):
    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _of(cost: str, state: str) -> str:
    return f"CASE {state} WHEN '0' THEN {cost}.c0 WHEN 's' THEN {cost}.cs WHEN 'u' THEN {cost}.cu ELSE {cost}.ca END"


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], [ord(c)::BIGINT for c in string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
  lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

ORACLE = rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS nth
  FROM k WHERE kind <> 0
), n AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS m FROM d
), f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM n
), c AS (
  SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM f
), back AS (
  SELECT conv_id, max(m) + 1 AS i, 0 AS c0, 10 AS cs, 5 AS cu, 0 AS ca FROM c GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(x0, 5 + xu, 10 + xa), least(xs, 5 + xu, 10 + xa), least(xu, 5 + xa), least(xa, 5 + xu) FROM (
    SELECT c.conv_id, c.i,
           least(2 + b.c0, CASE WHEN NOT gone THEN 1 + extra + b.cu END, CASE WHEN NOT gone AND r = 'u' THEN extra + b.cu END, CASE WHEN NOT gone AND r = 's' THEN extra + b.cs END) AS x0,
           least(2 + b.cs, CASE WHEN NOT gone THEN 1 + extra + b.cu END, CASE WHEN NOT gone AND r = 'u' THEN extra + b.cu END) AS xs,
           least(2 + b.cu, CASE WHEN NOT gone THEN 1 + extra + b.ca END, CASE WHEN NOT gone AND r = 'a' THEN extra + b.ca END) AS xu,
           least(2 + b.ca, CASE WHEN NOT gone THEN 1 + extra + b.cu END, CASE WHEN NOT gone AND r = 'u' THEN extra + b.cu END) AS xa
    FROM back b JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i - 1)
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, '0' AS st, '' AS audit, []::VARCHAR[] AS said FROM back WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN st WHEN 'K' THEN kept ELSE nx END, audit || e,
         CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE nx WHEN 'u' THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN role IS NOT NULL AND now = 2 + same THEN 'D' WHEN now = 5 + inserted THEN 'I' WHEN kept IS NOT NULL AND now = extra + after_kept THEN 'K' ELSE 'R' END AS e FROM (
      SELECT w.*, c.role, c.text, c.extra, {_of('b', 'w.st')} AS now, {_of('a', 'w.st')} AS same, {_of('b', 'w.nx')} AS inserted, w0.kept, {_of('a', 'w0.kept')} AS after_kept
      FROM (SELECT *, CASE st WHEN 'u' THEN 'a' ELSE 'u' END AS nx FROM walk) w
      JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i
      LEFT JOIN back a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
      LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.i = w.i,
      LATERAL (SELECT CASE WHEN c.gone THEN NULL WHEN w.st = '0' AND c.r = 's' THEN 's' WHEN w.st <> 'u' AND c.r = 'u' THEN 'u' WHEN w.st = 'u' AND c.r = 'a' THEN 'a' END AS kept) w0)
    WHERE role IS NOT NULL OR now > 0)
), last AS (
  SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM walk GROUP BY conv_id
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
         count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (i > 1 AND earlier || r NOT IN ('su', 'ua', 'au')) AS illegal FROM c GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(c0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN last ON last.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1
"""
