"""Conversation structure repair: a forward Viterbi search for the cheapest edits of each conversation.

The roles of a sound conversation read ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of user and
assistant. Four grammar states say what stands already: nothing, the system turn, a user turn, an assistant turn.
The search goes forward over a conversation's rows and carries for each state the least (cost, audit string); a row
is kept, given another role or deleted, and each layer is closed by at most two inserted turns. Nothing has to be
traced back: the audit string is the edits. Paths that another state's path undercuts by more than it can ever make
up are dropped, and what all living paths have in common is put aside, so a long conversation needs little memory.

Faults are found before: a row is blank, or repeats an earlier row of its conversation (found by a partial aggregation
of digests, not by a set in one task), or is cut off. The search sees narrow rows, without texts. The texts then pass,
in order, behind their conversation's audit string, through a running SHA-256. Both passes stream sorted rows, so a
task holds a batch of rows and one audit string; the rows of one conversation pass through one task, as a digest of
their order has to.

Defined results: null role or text is one blank, and so is a null conv_id or turn in the key of the damage; a null
conv_id is one conversation; null turns stand first; rows of one turn stand by role, then by the digest of role and
text; repeated rows stay and are duplicates of the first; a role's initial is its first character as it is, an empty
role has none and can't be kept; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import aliased, shuffle_partitions, staged

RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
CARRIED = 4096  # letters that paths carry before what they share is put aside
_BLANKS = " \t\n\x0b\x0c\r"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MEASURES = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"


class Search:
    """The layer of least (cost, audit) by state, after the rows seen so far."""

    def __init__(self) -> None:
        self.aside: list[str] = []
        self.paths: list[tuple[int, str] | None] = [(0, ""), None, None, None]
        self._close()

    def _close(self) -> None:
        """Insert a user turn, then an assistant turn; a third insertion would come back to a state at a higher cost."""
        p = self.paths
        for to, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            more = [(p[s][0] + INSERT, p[s][1] + "I") for s in sources if p[s] is not None]
            p[to] = min([*more, *([p[to]] if p[to] is not None else [])], default=None)
        # What the assistant state can do as well, for at most the deletion of a system turn, needs no other state.
        best = p[ASSISTANT][0]
        for state, slack in ((START, DELETE), (SYSTEM, 0)):
            if p[state] is not None and p[state][0] > best + slack:
                p[state] = None
        if max(len(x[1]) for x in p if x is not None) > CARRIED:
            shared = commonprefix([x[1] for x in p if x is not None])
            self.aside.append(shared)
            self.paths = [None if x is None else (x[0], x[1][len(shared) :]) for x in p]

    def row(self, initial: str, removed: bool, truncated: bool) -> None:
        p = self.paths
        out: list[list[tuple[int, str]]] = [[] if x is None else [(x[0] + DELETE, x[1] + "D")] for x in p]
        if not removed:
            extra = TRUNCATED if truncated else 0
            for to, letter, sources in ((SYSTEM, "s", (START,)), (USER, "u", (START, SYSTEM, ASSISTANT)), (ASSISTANT, "a", (USER,))):
                for s in sources:
                    if p[s] is not None:
                        if initial == letter:
                            out[to].append((p[s][0] + extra, p[s][1] + "K"))
                        if to != SYSTEM:
                            out[to].append((p[s][0] + extra + RELABEL, p[s][1] + "R"))
        self.paths = [min(x, default=None) for x in out]
        self._close()

    def result(self) -> tuple[int, str]:
        cost, audit = min(self.paths[s] for s in (START, ASSISTANT) if self.paths[s] is not None)
        return cost, "".join(self.aside) + audit


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, copy, dropped, role and text after the damage that each row's key calls for."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = aliased(conversations, conv_id="conv_id", turn=F.col("turn").cast("long"), role=F.coalesce("role", F.lit(" ")), text=F.coalesce("text", F.lit(" ")), harm=F.crc32(key) % 20)
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", copies.alias("copy"), (harm == 0).alias("dropped"), F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def digest(role: str = "role", text: str = "text") -> Column:
    """A digest of role and text, told apart by the role's length."""
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)), 256))


def faults(rows: DataFrame) -> DataFrame:
    """Rows without their texts: initial, blank, cut (the last character ends no sentence) and again (an earlier turn has the same)."""
    end = F.right(F.rtrim("text", F.lit(_BLANKS)), F.lit(1))
    narrow = rows.select("conv_id", "turn", "copy", "dropped", "role", digest().alias("digest"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut"))
    seen = narrow.where(~F.col("dropped")).groupBy("conv_id", "digest").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"))
    seen = seen.where((F.col("first") < F.col("last")) | F.col("unnumbered")).select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first", "unnumbered")
    both = narrow.join(seen, narrow["conv_id"].eqNullSafe(seen["_conv"]) & (narrow["digest"] == seen["_digest"]), "left")
    again = F.col("turn").isNotNull() & (F.col("unnumbered") | (F.col("first") < F.col("turn")))
    return both.select("conv_id", "turn", "copy", "dropped", "role", "digest", "blank", "cut", F.coalesce(again, F.lit(False)).alias("again"))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """The rows of each conversation together and in order."""
    order = ["conv_id", *first, F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)


class _Conversation:
    """What is known of the conversation whose rows are passing."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.search = conv_id, Search()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last = self.before = None

    def row(self, turn, role: str, digest: bytes, blank: bool, cut: bool, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        again = again or self.before == (turn, digest)
        self.before = (turn, digest)
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        duplicate = again and not blank
        truncated = cut and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.search.row(initial, blank or duplicate, truncated)

    def measures(self) -> tuple:
        cost, audit = self.search.result()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        for conv, turn, dropped, role, digest, blank, cut, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "role", "digest", "blank", "cut", "again")), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    out.append(now.measures())
                now = _Conversation(conv)
            if not dropped:
                now.row(turn, role, digest, blank, cut, again)
        kind = batch.schema.field("conv_id").type
        if out:
            yield _batch(out, kind)
    if now is not None:
        yield _batch([now.measures()], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """conv_id of its own kind, the counts, and whatever strings follow."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"][: len(rows[0])]
    kinds = [kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)


class _Repaired:
    """The digest of a repaired conversation, whose rows pass in order behind its audit string."""

    def __init__(self, measures: tuple) -> None:
        self.measures, self.audit, self.at, self.turns = measures, measures[-1], 0, 0
        self.sha, self.user = hashlib.sha256(), True  # user: the next user or assistant turn is the user's

    def _turn(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.turns else "") + f"{role}:{text}").encode())
        self.turns += 1

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._turn("user" if self.user else "assistant", "")
            self.user = not self.user
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._turn(role if edit == "K" else "user" if self.user else "assistant", text)
            if edit != "K" or role[:1] != "s":
                self.user = not self.user

    def result(self) -> tuple:
        self._inserts()
        return *self.measures, self.sha.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        heads = [batch.column(c) for c in ("conv_id", *_COUNTS, "audit")]
        kind = batch.schema.field("conv_id").type
        for i, (text, role) in enumerate(zip(batch.column("text").to_pylist(), batch.column("role").to_pylist(), strict=True)):
            if text is None:
                if now is not None:
                    out.append(now.result())
                now = _Repaired(tuple(c[i].as_py() for c in heads))
            else:
                now.row(role, text)
        if out:
            yield _batch(out, kind)
    if now is not None:
        yield _batch([now.result()], kind)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    ``conversations`` has conv_id, turn, copy, dropped, role and text, as ``damaged`` gives it.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    audits = staged(in_order(faults(conversations)).mapInArrow(_audits, f"conv_id {kind}, {_MEASURES}"), "audits")
    heads = audits.select(F.lit(0).alias("kind"), "*", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("copy", "int"), ("text", "string"))])
    left = conversations.where(~F.col("dropped"))
    rows = left.select(F.lit(1).alias("kind"), "conv_id", *[F.lit(None).cast("long").alias(c) for c in _COUNTS], F.lit(None).cast("string").alias("audit"), "turn", "role", digest().alias("digest"), "copy", "text")
    return in_order(heads.unionByName(rows), "kind").mapInArrow(_digests, f"conv_id {kind}, {_MEASURES}, repaired_sha256 string")


ORACLE_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(substr(key, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS harm FROM k),
e AS (SELECT conv_id, turn, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c WHERE harm <> 0),
o AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS initial,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, lag(left(role, 1)) OVER w AS before
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy)),
f AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS dup, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM o),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(dup) AS duplicate, count_if(cut) AS truncated,
  count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM f GROUP BY conv_id),
v AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {'c': 0, 'a': ''} AS p0, {'c': 1000000000, 'a': ''} AS p1, {'c': 5, 'a': 'I'} AS p2, {'c': 10, 'a': 'II'} AS p3 FROM m
  UNION ALL SELECT conv_id, pos, q0, q1, list_min([q2, {'c': q0.c + 5, 'a': q0.a || 'I'}, {'c': q1.c + 5, 'a': q1.a || 'I'}, {'c': q3.c + 5, 'a': q3.a || 'I'}]),
    list_min([q3, {'c': list_min([q2, {'c': q0.c + 5, 'a': q0.a || 'I'}, {'c': q1.c + 5, 'a': q1.a || 'I'}]).c + 5, 'a': list_min([q2, {'c': q0.c + 5, 'a': q0.a || 'I'}, {'c': q1.c + 5, 'a': q1.a || 'I'}]).a || 'I'}])
  FROM (SELECT v.conv_id, f.pos, {'c': p0.c + 2, 'a': p0.a || 'D'} AS q0,
    list_min([{'c': p1.c + 2, 'a': p1.a || 'D'}, {'c': p0.c + no + hard + CASE initial WHEN 's' THEN 0 ELSE 1000000000 END, 'a': p0.a || 'K'}]) AS q1,
    list_min([{'c': p2.c + 2, 'a': p2.a || 'D'}, {'c': u.c + no + hard + CASE initial WHEN 'u' THEN 0 ELSE 1000000000 END, 'a': u.a || 'K'}, {'c': u.c + no + hard + 1, 'a': u.a || 'R'}]) AS q2,
    list_min([{'c': p3.c + 2, 'a': p3.a || 'D'}, {'c': p2.c + no + hard + CASE initial WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': p2.a || 'K'}, {'c': p2.c + no + hard + 1, 'a': p2.a || 'R'}]) AS q3
    FROM (SELECT *, list_min([p0, p1, p3]) AS u FROM v) AS v JOIN (SELECT *, CASE WHEN blank OR dup THEN 1000000000 ELSE 0 END AS no, CASE WHEN cut THEN 5 ELSE 0 END AS hard FROM f) AS f
    ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = v.pos + 1) AS x),
b AS (SELECT m.*, list_min([p0, p3]) AS best FROM v JOIN m ON m.conv_id IS NOT DISTINCT FROM v.conv_id AND v.pos = m.n),
t AS (SELECT conv_id, best.a AS audit, unnest(range(1, len(best.a) + 1)) AS i FROM b),
a AS (SELECT conv_id, i, substr(audit, CAST(i AS INTEGER), 1) AS edit, count_if(substr(audit, CAST(i AS INTEGER), 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS pos FROM t),
r AS (SELECT a.conv_id, a.i, a.edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, edit = 'K' AND f.initial = 's' AS context FROM a LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.pos = f.pos WHERE edit <> 'D'),
s AS (SELECT *, count_if(NOT context) OVER (PARTITION BY conv_id ORDER BY i) AS nth FROM r),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS repaired FROM s GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, coalesce(repaired, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS d LEFT JOIN b ON d.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN z ON d.conv_id IS NOT DISTINCT FROM z.conv_id
"""
