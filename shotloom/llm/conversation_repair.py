"""Structure of conversations: faults after damage, and the cheapest edits that restore the order of turns.

``damage`` harms rows by a hash of conversation and turn (a stand-in for what crawls do), ``repair`` counts faults and
edits.  The program over edits is in ``audit_dp``: linked edit sequences with shared beginnings.

A conversation may hold a third of all rows.  Rows are sorted by conversation and turn across all tasks, whatever
conversation they belong to, and written down; a conversation that fits in one piece of ``PIECE`` sorted rows is solved where
its rows are read.  One that spans pieces is summed up per piece, the summaries are composed in groups level by level, and the
way chosen at the top goes back down to the pieces.  Only the digest of the repaired text needs all rows of a conversation in a
row: they stream past, sorted, and are not held.

Nulls count as one space in conv_id and turn where they are hashed and in role and text; rows without turn come first, rows
without conv_id are one conversation.  Equal turns follow each other by role, then by the first 64 letters and a hash of their
text; equal rows follow each other.  Empty texts are blank.  Long texts pass whole.  Extra columns are not read.  An empty
table gives no rows; a conversation that lost all its rows gives zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import audit_dp as D
from .common import release, stage

PIECE = 4096        # sorted rows per piece, a power of two
FAN = 2048          # pieces per group of a level
NO_WORD = r"[^\x20\x09-\x0D]"
ENDS_WELL = r"[.!?][\x20\x09-\x0D]*\z"
REPORT = "conv_id {key}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long, n_repaired long"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: rows harmed by crc32(conv_id:turn) % 20; a lost row stays as an empty mark."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind < 2, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), copies.alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of conversations and turns, written down with a number that follows this order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text")]
    fault = F.when(~F.col("text").rlike(NO_WORD), D.MUST_GO).when(~F.col("text").rlike(ENDS_WELL), D.CUT_SHORT).otherwise(D.FINE)
    placed = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *keys, F.col("place")).sortWithinPartitions(*keys).drop("place")
    return stage(placed.withColumn("pos", F.monotonically_increasing_id()).withColumn("fault", fault.cast("int")))


def _repeats(rows: DataFrame) -> DataFrame:
    """conv_id, pos of rows whose role and text came earlier in their conversation."""
    said = rows.where("NOT lost").select("conv_id", "pos", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    first = said.groupBy("conv_id", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    a, b = said.alias("a"), first.alias("b")
    return a.join(b, F.expr("a.conv_id <=> b.conv_id AND a.said = b.said AND a.pos > b.first")).select("a.conv_id", "a.pos")


def _groups(key: str, fold, out: str):
    """Batches sorted by (conv_id, key, …): rows of equal conv_id and ``key``, as lists of dicts, go to ``fold``."""
    def run(batches):
        now, held = None, []
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                at = (r["conv_id"], r[key])
                if held and at != now:
                    done += fold(held)
                    held = []
                now = at
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=fields)
        if held and (done := fold(held)):
            yield pa.RecordBatch.from_pylist(done, schema=fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = to_arrow_schema(T._parse_datatype_string(out))
    return run


def _folded(df: DataFrame, key: str, order: str, fold, out: str) -> DataFrame:
    """``fold`` over the rows of every (conv_id, key), sorted by ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id", key).sortWithinPartitions("conv_id", key, order).mapInArrow(_groups(key, fold, out), out)


def _step(r: dict) -> tuple[str, int]:
    return r["role"], r["fault"]


def _cut_letters(rows: DataFrame, repeats: DataFrame, piece: int, fan: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """conv_id, pos, letters for the rows of conversations that span pieces; and what to release after use."""
    key = rows.schema["conv_id"].dataType.simpleString()
    here = rows.where("NOT lost").select("conv_id", "pos", F.substring("role", 1, 1).alias("role"), "fault", F.shiftright("pos", piece.bit_length() - 1).alias("piece"))
    pieces = here.select("conv_id", "piece").distinct()
    spans = stage(pieces.withColumn("n", F.count("*").over(Window.partitionBy("conv_id"))).where("n > 1")
                  .withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("piece")).cast("long") - 1))
    if spans.isEmpty():
        return None, [spans]
    h, s, d = here.alias("h"), spans.alias("s"), repeats.alias("d")
    cut = h.join(s, F.expr("h.conv_id <=> s.conv_id AND h.piece = s.piece")).join(d, F.expr("h.conv_id <=> d.conv_id AND h.pos = d.pos"), "left")
    cut = stage(cut.select("h.conv_id", "h.pos", "h.role", F.when(F.col("d.pos").isNotNull(), D.MUST_GO).otherwise(F.col("h.fault")).alias("fault"), "s.k", (F.col("s.k") == F.col("s.n") - 1).alias("last")))
    levels = [stage(_folded(cut, "k", "pos", lambda g: [{"conv_id": g[0]["conv_id"], "k": g[0]["k"], "sums": D.summary(map(_step, g))}], f"conv_id {key}, k long, sums array<long>"))]
    while levels[-1].where("k > 0").limit(1).count():
        up = levels[-1].withColumn("g", F.floor(F.col("k") / fan).cast("long"))
        levels.append(stage(_folded(up, "g", "k", lambda g: [{"conv_id": g[0]["conv_id"], "k": g[0]["g"], "sums": D.compose([r["sums"] for r in g])}], f"conv_id {key}, k long, sums array<long>")))

    def top(batches):
        for b in batches:
            rows_ = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("k"), pa.array([D.START] * len(rows_), pa.int32()), pa.array([D.final_exit(r["sums"]) for r in rows_], pa.int32())],
                                             ["conv_id", "k", "enter", "leave"])
    ways = levels[-1].mapInArrow(top, f"conv_id {key}, k long, enter int, leave int")
    for level in reversed(levels[:-1]):
        below = level.withColumn("g", F.floor(F.col("k") / fan).cast("long")).alias("l")
        meet = below.join(ways.alias("w"), F.expr("l.conv_id <=> w.conv_id AND l.g = w.k")).select("l.conv_id", "l.g", "l.k", "l.sums", "w.enter", "w.leave")
        ways = _folded(meet, "g", "k", lambda g: [{"conv_id": r["conv_id"], "k": r["k"], "enter": e, "leave": x} for r, (e, x) in zip(g, D.route([r["sums"] for r in g], g[0]["enter"], g[0]["leave"]))],
                       f"conv_id {key}, k long, enter int, leave int")
    solve = cut.alias("c").join(ways.alias("w"), F.expr("c.conv_id <=> w.conv_id AND c.k = w.k")).select("c.conv_id", "c.k", "c.pos", "c.role", "c.fault", "c.last", "w.enter", "w.leave")
    letters = _folded(solve, "k", "pos", lambda g: [{"conv_id": r["conv_id"], "pos": r["pos"], "letters": t} for r, t in zip(g, D.piece_letters(map(_step, g), g[0]["enter"], g[0]["leave"], g[0]["last"]))],
                      f"conv_id {key}, pos long, letters string")
    return letters, [spans, cut, *levels]


class _Conversation:
    """Counts, audit and digest of one conversation whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.audit, self.sha = conv_id, [], [], hashlib.sha256()
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.kept = 0
        self.turns, self.low, self.high, self.before, self.state = 0, None, None, None, D.START

    def add(self, r: dict, repeat: bool, letters: str | None) -> None:
        self.n += 1
        turn, initial = r["turn"], r["role"][:1]
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, fault = initial, r["fault"]
        if fault == D.MUST_GO:
            self.blank += 1
        elif repeat:
            self.duplicate += 1
            fault = D.MUST_GO
        elif fault == D.CUT_SHORT:
            self.truncated += 1
        if letters is None:
            self.rows.append((initial, fault, r["role"], r["text"]))
        else:
            self.edit(letters, r["role"], r["text"], fault)

    def edit(self, letters: str, role: str, text: str, fault: int) -> None:
        self.audit.append(letters)
        for c in letters:
            self.cost += D.COST[c]
            if c == D.DELETE:
                continue
            if c == D.KEEP:
                self.state, line = D.INITIAL[role[:1]], f"{role}:{text}"
            else:
                self.state = D.ASSISTANT if self.state == D.USER else D.USER
                line = f"{'user' if self.state == D.USER else 'assistant'}:{'' if c == D.INSERT else text}"
            if c != D.INSERT and fault == D.CUT_SHORT:
                self.cost += D.TRUNCATED
            self.sha.update(("\n" * (self.kept > 0) + line).encode())
            self.kept += 1

    def report(self) -> dict:
        if self.rows:
            _, audit = D.repair([(i, f) for i, f, _, _ in self.rows])
            at = 0
            for k, (_, fault, role, text) in enumerate(self.rows):
                end = at
                while audit[end] == D.INSERT:
                    end += 1
                end = len(audit) if k == len(self.rows) - 1 else end + 1
                self.edit(audit[at:end], role, text, fault)
                at = end
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(), "n_rows": self.n, "n_repaired": self.kept}


def _finish(out: str):
    def run(batches):
        now, repeat, letters = None, False, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != now.conv_id:
                    if now is not None:
                        done.append(now.report())
                    now = _Conversation(r["conv_id"])
                if r["tag"] == 0:
                    repeat, letters = repeat or r["repeat"], r["letters"] if r["letters"] is not None else letters
                elif r["lost"]:
                    continue
                else:
                    now.add(r, repeat, letters)
                    repeat, letters = False, None
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=fields)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.report()], schema=fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = to_arrow_schema(T._parse_datatype_string(out))
    return run


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, lost): faults, cost, audit, digest of the repaired turns."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = _ordered(rows)
    repeats = stage(_repeats(placed))
    letters, used = _cut_letters(placed, repeats, piece, fan)
    texts = placed.selectExpr("conv_id", "pos", "1 tag", "lost", "turn", "role", "text", "fault", "false repeat", "CAST(null AS string) letters")
    blank = ["0 tag", "false lost", "CAST(null AS bigint) turn", "'' role", "'' text", "0 fault"]
    both = texts.union(repeats.selectExpr("conv_id", "pos", *blank, "true repeat", "CAST(null AS string) letters"))
    if letters is not None:
        both = both.union(letters.selectExpr("conv_id", "pos", *blank, "false repeat", "letters"))
    out = REPORT.format(key=rows.schema["conv_id"].dataType.simpleString())
    done = stage(both.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos", "tag").mapInArrow(_finish(out), out))
    release(placed, repeats, *used)
    return done
