"""Winnowing, turn repair and source divergence against brute force, with the cases that their docstrings define."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import divergence, turn_repair, winnowing
from test_operators import ODD, documents, prose  # the folder of this file is on the path

# -- op11 -----------------------------------------------------------------------------------------------


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
    return seed


def plain_print(text, gram=5, window=4):
    units = regex.findall(r"[฀-໿⺀-鿿가-힯豈-﫿\U00020000-\U0003FFFF]|[^\x20\x09-\x0D฀-໿⺀-鿿가-힯豈-﫿\U00020000-\U0003FFFF]{1,16}", text or "")
    hashes = [xxhash.xxh64_intdigest(u.encode(), 42) for u in units]
    if not hashes:
        return []
    if len(hashes) < gram:
        return [(0, chained(hashes) >> 12)]
    grams = [chained(hashes[i : i + gram]) >> 12 for i in range(len(hashes) - gram + 1)]
    signed = [g - (1 << 52) if g >> 51 else g for g in grams]
    kept = set()
    for s in range(max(1, len(grams) - window + 1)):
        span = range(s, min(len(grams), s + window))
        kept.add(min(span, key=lambda i: (signed[i], -i)))
    return sorted((i, grams[i]) for i in kept)


def test_winnowing_is_the_plain_loop(spark):
    texts = [t for _, t in ODD] + ["漢字かな交じり文の例です " * 3, "a b c d e", "a b c d e f g", "x " * 300, prose(4, 2051), prose(4, 2052), prose(4, 2053), prose(4, 4100)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: [tuple(g) for g in r.k] for r in rows.select("i", winnowing.winnowed(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    assert got == {i: plain_print(t) for i, t in enumerate(texts)}
    shown = rows.select("i", winnowing.written(winnowing.winnowed(F.coalesce("text", F.lit("")))).alias("w")).collect()
    for r in shown:
        entries = [r.w[k : k + 14] for k in range(0, len(r.w), 14)]
        assert list(zip(itertools.accumulate((int(e[13], 16) for e in entries), initial=-1), strict=False))[1:] == [(p,) for p, _ in got[r.i]]
        assert [int(e[:13], 16) for e in entries] == [h for _, h in got[r.i]]


def plain_edits(rows):
    """In descending order of doc_id, null last; the rows here that repeat a doc_id repeat the text as well."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = ({h for _, h in plain_print(x)} for x in (t, edited, after))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, b), 12), round(near(a, c), 12)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows", [[], [(7, prose(1, 30))], [(i, prose(i % 9, 5 + i)) for i in range(60)], [r for r in ODD if r[0] is not None] + [(None, "last of all, null")], [(5, prose(5, 40))] * 1200 + [(i, prose(i, 30)) for i in range(6, 20)]])
def test_edits_and_the_next_document(spark, rows, monkeypatch):
    monkeypatch.setattr(winnowing, "BUCKET_BYTES", 700)
    got = winnowing.compare_edits(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in got), key=repr) == plain_edits(rows)


def test_native_plan(spark):
    plan = winnowing.compare_edits(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- op12 -----------------------------------------------------------------------------------------------


def sound(roles):
    """Whether roles, ``*`` for a user or an assistant at will, can read (s?(ua)+)?."""
    n = len(roles)
    return not n or any(len(t) == n and all(r == x or (r == "*" and x != "s") for r, x in zip(roles, t, strict=True)) for t in ("ua" * (n // 2), "s" + "ua" * ((n - 1) // 2)) if len(t) > 1)


def cheapest(rows):
    """All edits of rows of (initial, removed, truncated), with up to two insertions at each place."""
    found = []
    for edits in itertools.product(*[["D"] if removed else ["K", "R", "D"] for _, removed, _ in rows]):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            left = iter(rows)
            turns = [(c, None if c == "I" else next(left)) for c in audit]
            if sound(["*" if c in "IR" else r[0] for c, r in turns if c != "D"]):
                found.append((sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] + 5 * (c in "KR" and r[2]) for c, r in turns), audit))
    return min(found)


def test_search_is_the_cheapest(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(12):
            rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            s = turn_repair.Search()
            for r in rows:
                s.row(*r)
            assert s.result() == cheapest(rows), rows


def test_long_paths_are_put_aside(monkeypatch):
    rng = random.Random(4)
    rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(3000)]
    told = []
    for carried in (1 << 30, 7):
        monkeypatch.setattr(turn_repair, "CARRIED", carried)
        s = turn_repair.Search()
        for r in rows:
            s.row(*r)
        told.append(s.result())
        assert carried > 7 or max(len(p[1]) for p in s.paths if p) < 500
    assert told[0] == told[1]


CONV = "conv_id long, turn long, role string, text string, copy string, kind int, digest string"


def plain_repair(rows):
    groups = collections.OrderedDict()
    for conv, turn, role, text in rows:
        out = groups.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else regex.sub("[.!?]", "", text) if harm == 2 else text
            out += [(turn, "user" if harm == 4 else role, text, k) for k in range(2 if harm == 3 else 1)]
    for conv, out in groups.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest(), r[3]))
        seen, facts, illegal = set(), [], 0
        for k, (_, role, text, _) in enumerate(out):
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            facts.append((role[:1], fault))
            illegal += k > 0 and facts[k - 1][0] + role[:1] not in ("su", "ua", "au")
        s = turn_repair.Search()
        for initial, fault in facts:
            s.row(initial, fault in ("blank", "duplicate"), fault == "truncated")
        cost, audit = s.result()
        lines, at, user = [], 0, True
        for c in audit:
            if c == "I":
                lines.append(f"{'user' if user else 'assistant'}:")
                user = not user
                continue
            _, role, text, _ = out[at]
            at += 1
            if c == "K" and role[:1] == "s":
                lines.append(f"{role}:{text}")
            elif c != "D":
                lines.append(f"{role if c == 'K' else 'user' if user else 'assistant'}:{text}")
                user = not user
        turns = [r[0] for r in out if r[0] is not None]
        count = collections.Counter(f for _, f in facts)
        yield conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_is_the_plain_loop(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", "  ", "What?", "Well. ", None, "A. B! C?", "x" * 5000, "naïve — 漢字🙂."]
    rows = [(c, rng.choice([None, *range(12)]) if c % 4 == 0 else t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for c in range(80) for t in range(rng.randrange(1, 12))]
    rows += [(None, t, "user", "Hello.") for t in range(5)] + [(500, 3, "user", "Same.")] * 6
    rows += [(c, 0, "user", "One.") for c in range(1000, 1040)]  # some of them lose their only row
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], CONV)
    got = turn_repair.repair(turn_repair.damaged(table)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(plain_repair(rows), key=repr)
    assert any(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert turn_repair.repair(turn_repair.damaged(table.limit(0))).collect() == []


# -- op13 -----------------------------------------------------------------------------------------------


def plain_audit(rows, top):
    """rows: (lang, source, text)"""
    uses, docs, groups = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), set()
    for lang, source, text in ((x or "", y or "", z or "") for x, y, z in rows):
        found = collections.Counter("".join(c.lower() if c < "\x80" else c for c in w) for w in regex.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        groups.add((lang, source))
        uses[lang, source].update(found)
        docs[lang].update(found.keys())
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, d in docs[lang].items() if d >= 3)
        counts = {s: [uses[lang, s][t] for t in kept] for x, s in groups if x == lang}
        counts[None] = [sum(c) for c in zip(*counts.values(), strict=True)] if kept else []
        p = {s: [1 + 10**9 * (n + 1) // (sum(c) + len(kept)) for n in c] for s, c in counts.items()}
        far = lambda x, y: (x - y) ** 2 // y
        for s in counts.keys() - {None}:
            pair = [(-sum(map(far, p[s], p[o])), o) for o in counts.keys() - {None, s}]
            term = [(-far(a, q), t) for t, n, a, q in zip(kept, counts[s], p[s], p[None], strict=True) if n and a > q]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                yield from ((lang, s, part, o, -v, k) for k, (v, o) in enumerate(found, 1))


def texts_of(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "É", "漢", "x-", "Q9", "zz", "ẞ", "i") for b in "klmnopq"]
    return [(rng.choice(["en", "de", None, "solo"]), "one" if (x := rng.random()) < 0.3 else None if x < 0.4 else f"s{rng.randrange(7)}", " ".join(rng.choices(words, range(len(words), 0, -1), k=rng.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("rows", [[], [("en", "a", None)], [("en", "a", "x y"), ("en", "b", "x"), ("en", "b", "")], [("en", f"s{i}", "same words here") for i in range(5)], [(x, y, None if i % 17 == 0 else t) for i, (x, y, t) in enumerate(texts_of(6, 300))] + [("solo", "only", "It's THE word " * 4000)]])
def test_divergence_is_exact(spark, rows):
    table = spark.createDataFrame([(i, t, x, y, 1, "t", "v") for i, (x, y, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, block int, term string, value string")
    got = divergence.audit(table, 5, block_sources=2, shard_entries=20).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_audit(rows, 5))


def test_large_counts_stay_exact():
    n = np.array([0, 9_223_372_034, 9_223_372_036, 1 << 60])
    assert divergence.shares(n, 1 << 62, 7).tolist() == [1 + 10**9 * (c + 1) // ((1 << 62) + 7) for c in n.tolist()]


def test_every_block_meets_every_other_once(spark):
    for blocks in range(1, 8):
        met = collections.Counter()
        for turn in range(blocks + blocks % 2 - 1):
            rows = spark.range(blocks).select(F.col("id").cast("int").alias("a"), divergence.opponent(F.col("id").cast("int"), F.lit(blocks), turn).alias("b")).where("a < b").collect()
            assert len({x for r in rows for x in r}) == 2 * len(rows)
            met.update(tuple(r) for r in rows)
        assert met == collections.Counter(itertools.combinations(range(blocks), 2))
