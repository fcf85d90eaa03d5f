"""Conversation repair over a bidirectional tight-arc DAG.

A node is (rows consumed, state), a state one of: nothing yet, after the system
turn, after a user turn, after an assistant turn. Edits are arcs with costs. The
least cost from the start (forward) and to an accepting end (backward) of every
node tell the tight arcs: those with forward + cost + backward equal to the least
cost of all. Each path of tight arcs is a cheapest repair. From the set of nodes
reached so far (the frontier) the least letter among its tight arcs is taken at
each step, which gives the cheapest repair of least letters.

A conversation may be of any length, so it's cut into blocks of at most 65,536
sorted rows. A block becomes a 4 x 4 table of costs between the states at its
ends; these tables, one a block, are chained both ways for the costs at all block
ends; then each block finds its own tight arcs and follows them from each state
that a cheapest path can have at its start, and the states at the block ends are
chained. Blocks hold codes only. Texts pass twice: range-sorted by conversation
and turn, and beside the letters, in order, through a running hash (a hash can't
be split, so a conversation's texts pass one task, in bounded memory).

Nulls in any column count as one space, but a null turn as none: it sorts first
and makes no gap. Rows of one turn follow by role, then text, both as damaged.
Rows alike in all are one row with a count. A conversation without rows after the
damage has zeros, no letters and the hash of an empty string. An empty table gives
no rows. Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, map_sized, stored, table

#: Rows of a block, as a power of two.
BLOCK_BITS = 16
INF = 1 << 60
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a turn that continues the conversation, by the state before.
FILL = (USER, USER, ASSISTANT, USER)
#: State after keeping a turn whose role begins with this letter.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Least cost to an accepting end behind the last row, by state.
ACCEPT = (0, 2 * INSERT, INSERT, 0)
ROLES = ("", "", "user", "assistant")
#: A code is an initial's place here, + 4 for a truncated row, or FORCED for one that must go.
INITIALS = "sua?"
FORCED = 8


def _arcs(code: int) -> list[list[tuple[str, int, int]]]:
    """(letter, cost, next state) of the arcs that consume a row, by state."""
    out = []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if code != FORCED:
            extra = CUT * (code >> 2)
            if (kept := KEEP.get((q, INITIALS[code & 3]))) is not None:
                arcs.append(("K", extra, kept))
            arcs.append(("R", REROLE + extra, FILL[q]))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(FORCED + 1)]


def fill_forward(v: list[int]) -> list[int]:
    """Costs at a place between rows, insertions there included."""
    user = min(v[USER], min(v[START], v[SYSTEM], v[ASSISTANT]) + INSERT)
    return [v[START], v[SYSTEM], user, min(v[ASSISTANT], user + INSERT)]


def fill_backward(v: list[int]) -> list[int]:
    user, assistant = min(v[USER], v[ASSISTANT] + INSERT), min(v[ASSISTANT], v[USER] + INSERT)
    return [min(v[START], user + INSERT), min(v[SYSTEM], user + INSERT), user, assistant]


def forward(v: list[int], code: int) -> list[int]:
    """Costs behind a row, from those in front of it."""
    out = [INF] * 4
    for q, arcs in enumerate(ARCS[code]):
        for _, cost, to in arcs:
            out[to] = min(out[to], v[q] + cost)
    return out


def backward(v: list[int], code: int) -> list[int]:
    return [min(cost + v[to] for _, cost, to in arcs) for arcs in ARCS[code]]


def transfer(codes: list[int]) -> list[list[int]]:
    """Least costs of a block from each state in front of it to each behind its last row."""
    out = []
    for start in range(4):
        v = [INF] * 4
        v[start] = 0
        for code in codes:
            v = forward(fill_forward(v), code)
        out.append([min(x, INF) for x in v])
    return out


def chain(tables: list[list[list[int]]]) -> tuple[int, list[list[int]], list[list[int]]]:
    """The least cost, and for the places between blocks the costs from the start (insertions there not yet made) and to the end."""
    ahead, behind = [[0, INF, INF, INF]], [list(ACCEPT)]
    for m in tables:
        ahead.append([min(INF, *(ahead[-1][p] + m[p][q] for p in range(4))) for q in range(4)])
    for m in reversed(tables):
        behind.append([min(INF, *(m[p][q] + behind[-1][q] for q in range(4))) for p in range(4)])
    return min(a + b for a, b in zip(ahead[-1], ACCEPT, strict=True)), ahead, behind[::-1]


def trace(codes: list[int], ahead: list[int], behind: list[int], total: int, last: bool) -> list[tuple[int, int, list[str]]]:
    """(state in front, state behind, letters of each row) along the tight arcs of least letters, for each state in front that a cheapest path has.

    A row's letters are the insertions in front of it and its own; those behind the last row of all go with that row.
    """
    n = len(codes)
    f = [fill_forward(ahead)]
    for k, code in enumerate(codes):
        v = forward(f[-1], code)
        f.append(fill_forward(v) if k < n - 1 or last else v)
    b = [behind]
    for code in reversed(codes):
        b.append(fill_backward(backward(b[-1], code)))
    b.reverse()
    out = []
    for start in range(4):
        if ahead[start] + b[0][start] != total:
            continue
        frontier, at, letters, rows = {start}, 0, "", []
        while True:
            if at == n and (not last or any(f[n][q] == total and q in (START, ASSISTANT) for q in frontier)):
                break
            steps: dict[str, set[int]] = {}
            for q in frontier:
                if at < n:
                    for letter, cost, to in ARCS[codes[at]][q]:
                        if f[at][q] + cost + b[at + 1][to] == total:
                            steps.setdefault(letter, set()).add(to)
                if f[at][q] + INSERT + b[at][FILL[q]] == total:
                    steps.setdefault("I", set()).add(FILL[q])
            letter = min(steps)
            frontier, letters = steps[letter], letters + letter
            if letter != "I":
                at += 1
                rows.append(letters)
                letters = ""
        if letters:
            rows[-1] += letters
        out.append((start, min(frontier), rows))
    return out


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(rows: DataFrame) -> DataFrame:
    """conv (id as text), turn, role, text and n (rows alike) after the damage; dropped rows are gone."""
    dealt = F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.regexp_replace(_key("text"), "[.!?]", "")).otherwise(_key("text"))
    hit = rows.select(_key("conv_id").alias("conv"), "turn", dealt.alias("dealt"), "role", "text").where("dealt != 0")
    out = hit.select("conv", "turn", F.when(F.col("dealt") == 4, "user").otherwise(_key("role")).alias("role"), text.alias("text"), F.when(F.col("dealt") == 3, 2).otherwise(1).alias("n"))
    return out.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with no, which ascends by conversation, turn, role and text; written once, since all later steps go by no."""
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    # the range keys are sampled at the driver: a text's beginning is enough to part the rows of a turn
    spread = rows.withColumn("head", F.substring("text", 1, 32)).repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "head")
    return stored(spread.drop("head").sortWithinPartitions(*keys).withColumn("no", F.monotonically_increasing_id()), "conversations")


def faults(ordered: DataFrame) -> DataFrame:
    """conv, no, turn, n, initial, and blank, repeated, truncated of the first of n rows alike (a further one is blank or repeated)."""
    text = F.col("text")
    rows = ordered.select("conv", "no", "turn", "n", F.substring("role", 1, 1).alias("initial"), (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)).alias("same"))
    seen = rows.groupBy("conv", "same").agg(F.min("no").alias("least"), F.count("*").alias("times")).where("times > 1").drop("times")
    out = rows.join(seen, ["conv", "same"], "left")
    repeated = ~F.col("blank") & F.coalesce(F.col("no") > F.col("least"), F.lit(False))
    return out.select("conv", "no", "turn", "n", "initial", "blank", repeated.alias("repeated"), (~F.col("blank") & ~repeated & F.col("cut")).alias("truncated"))


def reports(marked: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate and truncated: sums by turn, then by conversation."""
    n, blank = F.col("n"), F.col("blank")
    by_turn = marked.groupBy("conv", "turn").agg(
        F.sum(F.when(blank, n).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(F.col("repeated"), n).otherwise(n - 1)).alias("duplicate"),
        F.count_if("truncated").alias("truncated"),
    )
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))


def blocks(marked: DataFrame) -> DataFrame:
    """conv, block and its rows (no, code, n, initial) in order."""
    place = F.coalesce(*(F.when(F.col("initial") == c, k) for k, c in enumerate(INITIALS[:3])), F.lit(3))
    code = F.when(F.col("blank") | F.col("repeated"), FORCED).otherwise(place + F.when(F.col("truncated"), 4).otherwise(0))
    rows = marked.select("conv", F.shiftright("no", BLOCK_BITS).alias("block"), F.struct("no", code.cast("int").alias("code"), F.col("n").cast("long").alias("n"), place.cast("int").alias("initial")).alias("row"))
    return rows.groupBy("conv", "block").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _codes(rows: list[dict]) -> list[int]:
    """The codes of a block's rows one by one; further rows alike must go."""
    out = []
    for r in rows:
        out.append(r["code"])
        out += [FORCED] * (r["n"] - 1)
    return out


def _legal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] in ("su", "ua", "au")


def tables(cut: DataFrame) -> DataFrame:
    """conv, block, costs (16), illegal pairs inside, and the initials at its ends."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for rows in batch.column(2).to_pylist():
            pairs = sum(r["n"] - 1 for r in rows) + sum(not _legal(a["initial"], b["initial"]) for a, b in zip(rows, rows[1:], strict=False))
            out.append(([x for line in transfer(_codes(rows)) for x in line], pairs, rows[0]["initial"], rows[-1]["initial"]))
        costs, illegal, first, last = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["conv", "block", "costs", "illegal", "first", "last"])

    return map_batches(cut, ["conv", "block", "rows"], run, "conv string, block bigint, costs array<bigint>, illegal bigint, `first` int, `last` int")


def chained(summary: DataFrame) -> DataFrame:
    """conv, cost, illegal and for each block the costs at its two ends. One small row a block meets in a task."""
    gathered = summary.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "illegal", "first", "last"))).alias("all"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for cells in batch.column(1).to_pylist():
            total, ahead, behind = chain([[c["costs"][4 * p : 4 * p + 4] for p in range(4)] for c in cells])
            illegal = sum(c["illegal"] for c in cells) + sum(not _legal(a["last"], b["first"]) for a, b in zip(cells, cells[1:], strict=False))
            out.append((total, illegal, [{"block": c["block"], "ahead": ahead[k], "behind": behind[k + 1], "final": k == len(cells) - 1} for k, c in enumerate(cells)]))
        cost, illegal, ends = zip(*out, strict=True)
        kind = pa.list_(pa.struct([("block", pa.int64()), ("ahead", pa.list_(pa.int64())), ("behind", pa.list_(pa.int64())), ("final", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ends, kind)], names=["conv", "cost", "illegal", "ends"])

    return map_batches(gathered, ["conv", "all"], run, "conv string, cost bigint, illegal bigint, ends array<struct<block: bigint, ahead: array<bigint>, behind: array<bigint>, final: boolean>>")


def traced(cut: DataFrame, costs: DataFrame) -> DataFrame:
    """conv, block, state in front, state behind, and letters of each row (no) for each state in front that a cheapest path has."""
    ends = costs.select("conv", "cost", F.explode("ends").alias("at")).select("conv", "cost", "at.*")
    joined = cut.join(ends, ["conv", "block"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        conv, block, start, end, letters = [], [], [], [], []
        for r in batch.to_pylist():
            rows = r["rows"]
            for a, z, single in trace(_codes(rows), r["ahead"], r["behind"], r["cost"], r["final"]):
                pieces, at = [], 0
                for x in rows:
                    pieces.append({"no": x["no"], "edits": "".join(single[at : at + x["n"]])})
                    at += x["n"]
                conv.append(r["conv"])
                block.append(r["block"])
                start.append(a)
                end.append(z)
                letters.append(pieces)
        kind = pa.list_(pa.struct([("no", pa.int64()), ("edits", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.string()), pa.array(block, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(letters, kind)], names=["conv", "block", "start", "finish", "letters"])

    return map_batches(joined, ["conv", "block", "rows", "cost", "ahead", "behind", "final"], run, "conv string, block bigint, `start` int, finish int, letters array<struct<no: bigint, edits: string>>")


def letters(paths: DataFrame) -> DataFrame:
    """conv, no and edits of each row along the cheapest repair: the states at the block ends follow one from the other."""
    gathered = paths.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "start", "finish"))).alias("all"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for cells in batch.column(1).to_pylist():
            to = {(c["block"], c["start"]): c["finish"] for c in cells}
            state, chosen = START, []
            for block in sorted({c["block"] for c in cells}):
                chosen.append({"block": block, "start": state})
                state = to[block, state]
            out.append(chosen)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32())])))], names=["conv", "chosen"])

    chosen = map_batches(gathered, ["conv", "all"], run, "conv string, chosen array<struct<block: bigint, `start`: int>>")
    at = chosen.select("conv", F.explode("chosen").alias("at")).select("conv", "at.*")
    return paths.join(at, ["conv", "block", "start"]).select("conv", F.explode("letters").alias("row")).select("conv", "row.*")


def apply_edits(edits: str, role: str, text: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) that a row's letters make, and the state behind."""
    out = []
    for letter in edits:
        if letter == "K":
            state = KEEP[state, role[:1]]
            out.append((role, text))
        elif letter != "D":
            state = FILL[state]
            out.append((ROLES[state], text if letter == "R" else ""))
    return out, state


def _with_texts(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows and letters by conversation in order, a row's letters in front of it."""
    none = F.lit(None).cast("string")
    rows = ordered.select("conv", "no", F.lit(1).alias("kind"), none.alias("edits"), "role", "text")
    return rows.unionByName(chosen.select("conv", "no", F.lit(0).alias("kind"), "edits", none.alias("role"), none.alias("text"))).repartition("conv").sortWithinPartitions("conv", "no", "kind").select("conv", "edits", "role", "text")


def repaired(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv, place, role and text of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, place, edits = None, START, 0, ""
        for batch in map_sized(batches):
            made = []
            for conv, piece, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != own:
                    own, state, place = conv, START, 0
                if piece is not None:
                    edits = piece
                    continue
                turns, state = apply_edits(edits, role, text, state)
                for r, t in turns:
                    made.append((conv, place, r, t))
                    place += 1
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv", "place", "role", "text"])

    return _with_texts(ordered, chosen).mapInArrow(run, "conv string, place bigint, role string, text string")


def digests(ordered: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv, audit (all letters) and repaired_sha256 of its turns as `role:text` lines: rows stream in order, one hash at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, edits, audit, lines, sha = None, START, "", [], 0, None
        for batch in map_sized(batches):
            done = []
            for conv, piece, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != own:
                    if own is not None:
                        done.append((own, "".join(audit), sha.hexdigest()))
                    own, state, audit, lines, sha = conv, START, [], 0, hashlib.sha256()
                if piece is not None:
                    edits = piece
                    audit.append(piece)
                    continue
                turns, state = apply_edits(edits, role, text, state)
                for r, t in turns:
                    sha.update(f"{chr(10) if lines else ''}{r}:{t}".encode())
                    lines += 1
            yield _digest_batch(done)
        if own is not None:
            yield _digest_batch([(own, "".join(audit), sha.hexdigest())])

    return _with_texts(ordered, chosen).mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def _digest_batch(done: list[tuple[str, str, str]]) -> pa.RecordBatch:
    columns = zip(*done, strict=True) if done else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["conv", "audit", "repaired_sha256"])


class Repair:
    """The steps over one table of (conv, turn, role, text, n), each stored where a later one reads it twice."""

    def __init__(self, rows: DataFrame):
        self.ordered = in_order(rows)
        self.marked = stored(faults(self.ordered), "faults")
        self.cut = stored(blocks(self.marked), "blocks")
        self.costs = stored(chained(tables(self.cut)), "costs")
        self.letters = letters(stored(traced(self.cut, self.costs), "paths"))

    def turns(self) -> DataFrame:
        return repaired(self.ordered, self.letters)

    def report(self) -> DataFrame:
        return reports(self.marked).join(self.costs.select("conv", "illegal", "cost"), "conv").join(digests(self.ordered, self.letters), "conv")


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = Repair(damage(given)).report()
    all_ids = given.groupBy(_key("conv_id").alias("conv")).agg(F.max("conv_id").alias("conv_id"))
    long = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return all_ids.join(found, "conv", "left").select("conv_id", *map(long, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


OP11_SQL = r"""
WITH RECURSIVE
t(i, c) AS MATERIALIZED (SELECT i, list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i) FROM range(256) r(i)),
lut AS MATERIALIZED (SELECT list(c ORDER BY i) AS c FROM t),
src AS (SELECT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(turn::VARCHAR, ' ') AS turn_key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hit AS (SELECT *, xor(list_reduce(list_transform(string_split(conv || ':' || turn_key, ''), lambda ch: ascii(ch)::BIGINT), lambda x, y: xor(x >> 8, lut.c[xor(x & 255, y) + 1]), 4294967295), 4294967295) % 20 AS h FROM src, lut),
dam AS (SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM dam),
num AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut, substr(role, 1, 1) AS c FROM placed),
r AS MATERIALIZED (SELECT *, blank OR seen > 1 AS gone, NOT blank AND seen = 1 AND cut AS trunc, lag(c) OVER (PARTITION BY conv ORDER BY i) AS p FROM num),
rep AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND seen > 1) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv),
z AS (SELECT 1000000 AS c, '' AS a, '' AS r),
-- n, s, u, a: cheapest (cost, letters, turns) in each state behind row i, before any insertion there
w AS (
  SELECT conv, 0::BIGINT AS i, {'c': 0, 'a': '', 'r': ''} AS n, {'c': 1000000, 'a': '', 'r': ''} AS s, {'c': 1000000, 'a': '', 'r': ''} AS u, {'c': 1000000, 'a': '', 'r': ''} AS a FROM (SELECT DISTINCT conv FROM src)
  UNION ALL
  SELECT conv, i,
    {'c': n2.c + 2, 'a': n2.a || 'D', 'r': n2.r},
    list_sort([{'c': s2.c + 2, 'a': s2.a || 'D', 'r': s2.r}, {'c': n2.c + k + CASE WHEN role_c = 's' THEN 0 ELSE 1000000 END, 'a': n2.a || 'K', 'r': n2.r || role || ':' || text || chr(10)}])[1],
    list_sort([{'c': u2.c + 2, 'a': u2.a || 'D', 'r': u2.r}]
      || list_transform([n2, s2, a2], lambda x: {'c': x.c + k + CASE WHEN role_c = 'u' THEN 0 ELSE 1000000 END, 'a': x.a || 'K', 'r': x.r || role || ':' || text || chr(10)})
      || list_transform([n2, s2, a2], lambda x: {'c': x.c + k + 1, 'a': x.a || 'R', 'r': x.r || 'user:' || text || chr(10)}))[1],
    list_sort([{'c': a2.c + 2, 'a': a2.a || 'D', 'r': a2.r}, {'c': u2.c + k + CASE WHEN role_c = 'a' THEN 0 ELSE 1000000 END, 'a': u2.a || 'K', 'r': u2.r || role || ':' || text || chr(10)}, {'c': u2.c + k + 1, 'a': u2.a || 'R', 'r': u2.r || 'assistant:' || text || chr(10)}])[1]
  FROM (
    SELECT conv, i, role, text, role_c, k, n2, s2, u2, list_sort([a1, {'c': u2.c + 5, 'a': u2.a || 'I', 'r': u2.r || 'assistant:' || chr(10)}])[1] AS a2
    FROM (
      SELECT w.conv, r.i, r.role, r.text, r.c AS role_c, CASE WHEN r.gone THEN 1000000 WHEN r.trunc THEN 5 ELSE 0 END AS k, w.n AS n2, w.s AS s2, w.a AS a1,
        list_sort([w.u] || list_transform([w.n, w.s, w.a], lambda x: {'c': x.c + 5, 'a': x.a || 'I', 'r': x.r || 'user:' || chr(10)}))[1] AS u2
      FROM w JOIN r ON r.conv = w.conv AND r.i = w.i + 1))),
fin AS (SELECT conv, list_sort([n, a, {'c': u.c + 5, 'a': u.a || 'I', 'r': u.r || 'assistant:' || chr(10)}, {'c': s.c + 10, 'a': s.a || 'II', 'r': s.r || 'user:' || chr(10) || 'assistant:' || chr(10)}])[1] AS x FROM w WHERE i = coalesce((SELECT max(i) FROM r WHERE r.conv = w.conv), 0))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, fin.x.c::BIGINT AS cost, fin.x.a AS audit, sha256(fin.x.r[:-2]) AS repaired_sha256
FROM (SELECT conv, max(conv_id) AS conv_id FROM src GROUP BY conv) o JOIN fin USING (conv) LEFT JOIN rep USING (conv)
"""
