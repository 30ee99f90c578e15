"""The ten operators on small tables, against brute force, with the cases that each docstring defines."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import dimension_scan, kdtree, license_scan, perspectives, piece_codec, simhash, source_mix, substring_dedup, token_shards, toxicity
from paperloom.llm.wavelet import WaveletMatrix

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch maple north ocean pearl quartz river stone thorn umber vale willow xenon yarrow zephyr".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long, bucket int, part int, size double"


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def documents(spark, rows):
    """doc_id, text (and source) with further columns whose names the operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 1, 2, 3, 4.0) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, prose(1, 60)), (6, prose(1, 60)), (6, prose(1, 60)), (None, prose(2, 50)), (None, "a  b   c\n\n\nd "), (7, prose(3, 30000)), (8, "naïve — “quoted”  漢字🙂\t\x00 x\xa0 y"), (9, "w" * 20000), (10, "x <|endoftext|> y"), (11, "▁ ▁a")]


def spoken(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# -- op1 ------------------------------------------------------------------------------------------------


def test_wavelet_matrix_answers():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1000, 7), (5000, 300)):
        x = rng.integers(0, top, n).astype(np.uint16)
        w = WaveletMatrix.build(x, 9)
        assert (w.decode() == x).all()
        if n:
            i = rng.integers(0, n, 50)
            assert (w.access(i) == x[i]).all()
            assert w.rank(x[i], i).tolist() == [(x[:k] == c).sum() for c, k in zip(x[i], i, strict=True)]
            c = int(x[0])
            assert w.count(c) == (x == c).sum()
            assert (w.select(c, np.arange(w.count(c))) == np.flatnonzero(x == c)).all()


def test_token_shards(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = documents(spark, ODD)
    manifest = token_shards.write_shards(docs, P.path("byte_bpe_50k.json"), 2, shard_tokens=5000)
    got = spoken(token_shards.read_digests(manifest).collect())
    order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in order] == sorted((r[0] for r in ODD), key=lambda d: (d is not None, d))
    assert [r[1] for r in order] == np.cumsum([0, *[r[2] for r in order]])[:-1].tolist()
    want = collections.Counter((d, len(i := t.encode(x or "", add_special_tokens=False).ids) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for d, x in ODD)
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    shard = token_shards.ShardFile(token_shards.read_file(manifest.orderBy("start").first().path))
    ids = shard.tokens()
    assert shard.count(2) == (ids == 2).sum() and (shard.occurrences(2) == np.flatnonzero(ids == 2)).all() and shard.count(50255) == (ids == 50255).sum()
    empty = token_shards.write_shards(docs.limit(0), P.path("byte_bpe_50k.json"), 2)
    assert token_shards.read_digests(empty).count() == 0


def test_units_encode_as_whole_texts():
    from tokenizers import Tokenizer

    e = token_shards.UnitEncoder(P.path("byte_bpe_50k.json"))
    texts = ["", " ", "  ", "a  b", "a   b", " a", "a \n", "a \nb", "\n\n\nx", "x\xa0 y", "x \xa0", "\t\t a", "a\r\nb", "don't  'll", "é 　 b", "a　", "🙂 🙂  🙂", "x\x1c y", "12 345  \n 67"]
    texts += ["<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>", "x<|endoftext|>\n", "<|endoftext|"]
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for part in (texts, *np.array_split(np.array(random_texts(6, 3000), object), 60)):
        ids, counts = e.encode(pa.array(list(part), pa.string()))
        assert split(ids, counts) == [plain.encode(t, add_special_tokens=False).ids for t in part]


# -- op2 ------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    grant = license_scan.TEMPLATES["mit-grant"]
    cut = " ".join(grant.split()[:-3])  # most of the shingles are left
    rows = [(1, f"{prose(1, 40)}\nReleased under the MIT License.\n{prose(2, 30)}"), (2, f"{prose(3, 90)} {cut} {prose(4, 10)}"), (3, prose(5, 200)), (4, "under the MIT License"), (5, grant.upper()), *ODD]
    got = spoken(license_scan.summary(license_scan.scan(documents(spark, rows))).select("doc_id", "license").collect())
    assert got == [(1, "mit"), (2, "mit-grant"), (5, "mit-grant")]
    assert license_scan.scan(documents(spark, [])).count() == 0
    with pytest.raises(ValueError, match="fewer than 5"):
        license_scan.Templates((("short", "too few words"),))


def test_license_scan_finds_what_brute_force_finds():
    t = license_scan._built(tuple(license_scan.TEMPLATES.items()))
    text = f"{prose(1, 70)} {license_scan.TEMPLATES['bsd-3-clause']} {prose(2, 40)} licensed under cc by-nc 4.0 {prose(3, 9)}"
    words, _ = license_scan._tokens(pa.array([text]))
    own, want = license_scan.shingles(words), set()
    for c, shingles in enumerate(t.sets):
        n, s = int(t.size[c]), int(t.step[c])
        for k in range(0, len(own), s):
            if np.isin(shingles, own[k : k + n + s - 4]).mean() >= 0.8:
                want.add((t.names[c], k))
    assert {(m[0], m[1]) for m in license_scan.matches(t, words)} == want and want


def test_every_notice_is_found_whole():
    t = license_scan._built(tuple(license_scan.TEMPLATES.items()))
    for name, notice in license_scan.TEMPLATES.items():
        words, _ = license_scan._tokens(pa.array([f"{prose(1, 33)}\n{notice}\n{prose(2, 41)}"]))
        assert any(m[0] == name and m[3] == 1.0 for m in license_scan.matches(t, words)), name


def test_bands_decide_among_near_identical_templates():
    rng = np.random.default_rng(12)
    base = prose(900, 60).split()
    texts = {}
    for k in range(150):  # from a few to nearly all words changed: most fail the containment, some agree in bands
        w = list(base)
        for i in rng.choice(60, int(rng.integers(0, 45)), replace=False):
            w[i] = f"w{k}x{i}"
        texts[f"t{k:03}"] = " ".join(w)
    t = license_scan.Templates(tuple(texts.items()))
    words, _ = license_scan._tokens(pa.array([f"{prose(1, 50)} {' '.join(base)} {prose(2, 50)}"]))
    own, want, seen = license_scan.shingles(words), set(), 0
    for c, some in enumerate(t.sets):
        best = max(np.isin(some, own[k : k + 60 + 15 - 4]).mean() for k in range(0, len(own), 15))
        want |= {t.names[c]} if best >= 0.8 else set()
        seen += 0 < best < 0.5
    assert {m[0] for m in license_scan.matches(t, words)} >= want and 2 < len(want) < 75 and seen > 20
    assert all(np.isin(t.sets[t.names.index(m[0])], own).mean() >= 0.8 for m in license_scan.matches(t, words))


def test_a_long_text_of_notices_is_compared_part_by_part(monkeypatch):
    t = license_scan._built(tuple(license_scan.TEMPLATES.items()))
    words, _ = license_scan._tokens(pa.array([" ".join([license_scan.TEMPLATES["bsd-3-clause"], prose(1, 7)] * 300)]))
    want = license_scan.matches(t, words)
    monkeypatch.setattr(license_scan, "MOST_WINDOWS", 7)
    assert license_scan.matches(t, words) == want and len(want) > 300


def test_license_scan_finds_notices_with_inserted_words():
    t = license_scan._built(tuple(license_scan.TEMPLATES.items()))
    grant = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
    c = t.names.index("mit-grant")
    for start in range(60, 84):
        words, _ = license_scan._tokens(pa.array([f"{prose(1, start)} {grant} {prose(2, 50)}"]))
        own = license_scan.shingles(words)
        best = max(np.isin(t.sets[c], own[i : i + 29 - 4]).mean() for i in range(len(own)))  # every start of 29 words
        found = [m for m in license_scan.matches(t, words) if m[0] == "mit-grant"]
        assert best >= 0.8 and found and max(m[3] for m in found) == best, start


# -- op3 ------------------------------------------------------------------------------------------------


def test_license_sql_says_longer_windows_too(spark):
    import duckdb

    rng = np.random.default_rng(12)
    rows = []
    for i, body in enumerate(list(license_scan.TEMPLATES.values()) * 3):
        words = body.split()
        for _ in range(int(rng.integers(0, max(1, len(words) // 12) + 1))):  # inserted words, as many as some windows bear
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(WORDS)))
        rows.append((i, f"{prose(300 + i, int(rng.integers(0, 20)))} {' '.join(words)} {prose(400 + i, 9)}"))
    table = documents(spark, rows)
    c = duckdb.connect()
    c.register("documents", table.select("doc_id", "text").toPandas())
    want = c.sql(license_scan.ORACLE_SQL).fetchall()
    got = license_scan.summary(license_scan.scan(table)).collect()
    assert sorted((r.doc_id, r.license, r.n_windows, round(r.containment, 9), r.first_word) for r in got) == sorted((a, b, n, round(x, 9), f) for a, b, n, x, f in want)
    assert len(want) > len(rows) / 2


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", None), (1, 3, "ann", "bye"), (2, 0, "system", "alone"), (None, None, None, "lost"), (3, 1, "x", "twice"), (3, 1, "x", "twice")]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, perspective string, mask int")
    got = perspectives.rotate(df).collect()
    assert collections.Counter((r.conv_id, r.perspective) for r in got) == {(1, "ann"): 4, (1, "bob b"): 4, (None, "unknown"): 1, (3, "x"): 2}
    ann = sorted((r for r in got if (r.conv_id, r.perspective) == (1, "ann")), key=lambda r: r.turn)
    assert "".join(r.rendered for r in ann) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob_x20_b\n<|im_end|>\n<|im_start|>assistant\nbye<|im_end|>\n"
    assert [r.mask for r in ann] == [0, 1, 0, 1]
    assert [r.rendered[r.loss_start : r.loss_end] for r in ann] == ["", "hi < |im_end|><|im_end|>", "", "bye<|im_end|>"]
    assert perspectives.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [60, 1 << 20])
def test_dialogues_are_their_turns(spark, most):
    rows = [(c, t, ["system", "user", "assistant", "guest"][t % 4 if t else 0], f"{prose(50 * c + t, t % 5)} 🙂") for c in range(3) for t in range(2 + 9 * c)] + [(9, None, "user", "x"), (9, 1, "user", "x"), (9, 1, "user", "x")]
    turns = perspectives.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    whole = collections.defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.perspective, r.turn is not None, r.turn or 0, r.speaker, r.rendered)):
        whole[r.conv_id, r.perspective].append(r)
    parts = collections.defaultdict(list)
    for r in sorted(perspectives.dialogues(turns, most).collect(), key=lambda r: r.part):
        parts[r.conv_id, r.perspective].append(r)
    assert set(parts) == set(whole) and (most > 60 or max(map(len, parts.values())) > 3)
    for key, told in parts.items():
        assert "".join(r.text for r in told) == "".join(r.rendered for r in whole[key])
        assert [r.text[m.start : m.end] for r in told for m in r.masks] == [r.rendered[r.loss_start : r.loss_end] for r in whole[key] if r["mask"]]
    turns.unpersist()


def test_different_speakers_have_different_names(spark):
    who = ["a b", "a_b", "a_x20_b", "a\nb", "a", "🙂", "", "_x", "__x", "_", "x", "a-b", "é"]
    df = spark.createDataFrame([(1, i, w, "hi") for i, w in enumerate(who)], "conv_id long, turn long, role string, text string")
    names = {r.speaker: r.name for r in perspectives.rotate(df).where("perspective = 'x' and speaker <> 'x'").collect()}
    assert len(set(names.values())) == len(who) - 1 and all(re.fullmatch("[A-Za-z0-9_-]*", n) for n in names.values())
    assert (names["a_b"], names["a-b"], names["a b"]) == ("a_b", "a-b", "a_x20_b")


def test_perspectives_of_a_long_conversation(spark):
    df = spark.range(30000).selectExpr("1L as conv_id", "id as turn", "concat('s', id % 3) as role", "'t' as text")
    got = perspectives.rotate(df).groupBy("perspective").agg(F.sum("mask"), F.count("turn")).collect()
    assert spoken(got) == [(f"s{k}", 10000, 30000) for k in range(3)]


# -- op4 ------------------------------------------------------------------------------------------------


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automata_find_what_distances_say():
    terms = ["grimble", "snorp", "blat", "grumble"]
    lexicon = toxicity.Lexicon([(t, False) for t in terms] + [("zork", True)])
    rng = np.random.default_rng(5)
    words = set(terms)
    for t in [*terms, "zorkish", "zorkel"]:
        for _ in range(60):
            w, k = list(t), int(rng.integers(0, 3))
            for _ in range(k):
                i, c = int(rng.integers(0, len(w) + 1)), "abgimnorsz"[int(rng.integers(0, 10))]
                w[i : i + int(rng.integers(0, 2))] = [c] if rng.random() < 0.7 else []
            words.add("".join(w))
    for w in words:
        near = [(d, t) for t in terms if (d := levenshtein(w, t)) == 0 or (d == 1 and len(t) >= 5)]
        hit = lexicon.find(w)
        if w.startswith("zork"):
            assert hit is not None
        elif near:
            assert hit is not None and hit[0] == min(near)[0], w
        else:
            assert hit is None, w


def labelled(spark, n=400):
    bad = ["grimble", "snorpish", "blatface"]
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choice(WORDS, 60).tolist()
        for _ in range(4 if toxic else 0):
            words.insert(int(rng.integers(0, 60)), bad[int(rng.integers(0, 3))])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (99999, 0, 1), (0, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity_holds_out(spark):
    docs, labels = labelled(spark)
    extra = [(1000, None), (1001, ""), (1002, "You grimbel, you snorpis, you blatfaced grimblee " + prose(7, 30)), (1003, 'He said "grimble" once. ' + prose(8, 200)), (None, prose(9, 20))]
    got = {r.doc_id: r for r in toxicity.classify(documents(spark, docs + extra), labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None) and not got[None].held_out
    assert got[1000].predicted == got[1001].predicted == got[None].predicted == 0 and got[1003].predicted == 0 and got[1003].score < got[1002].score
    kept = toxicity.without_toxic(documents(spark, docs), labels)
    assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} == {i for i in range(400) if i % 4}


def test_toxic_words_are_not_displaced_by_their_beginnings(spark):
    docs, labels = labelled(spark)
    lexicon = toxicity.fit(documents(spark, docs), labels).lexicon
    assert {("grimble", False), ("snorpish", False), ("blatface", False)} <= set(lexicon.entries)
    assert all(len(w) >= toxicity.FUZZY for w, _ in lexicon.entries)  # a beginning that tells no more than the word
    for w in ("grymble", "gimble", "srnorpish", "bltface"):  # one edit within the first four letters
        assert lexicon.find(w)[0] == 1, w


def test_misspellings_that_the_sample_lacks_count(spark):
    docs, labels = labelled(spark)
    docs = [(i, f"{t} blatfase" if i % 4 == 1 else t) for i, t in docs]  # a near-word that clean texts hold
    new = [(2000, f"{prose(90, 30)} you grymble {prose(91, 30)}"), (2001, f"{prose(92, 30)} snropish snrpish snorpisch {prose(93, 30)}"), (2002, f"{prose(94, 30)} blatfase {prose(95, 30)}")]
    got = {r.doc_id: r.predicted for r in toxicity.classify(documents(spark, docs + new), labels).collect()}
    assert (got[2000], got[2001], got[2002]) == (1, 1, 0)
    assert all(got[i] == int(i % 4 == 0) for i in range(400))


def test_rare_toxic_terms_are_learned(spark):
    docs, k = [], 0
    for i in range(3200):
        toxic = i % 4 == 0
        words = [*prose(5000 + i, 14).split(), *(["grimble"] if toxic else [])]
        if toxic and zlib.crc32(str(i).encode()) % 5 and (k := k + 1) <= 10:  # of about 640 toxic texts that teach
            words.append("quibblor")
        docs.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    assert ("quibblor", False) in toxicity.fit(documents(spark, docs), labels).lexicon.entries


def test_scores_are_what_plain_loops_say(spark):
    docs, labels = labelled(spark)
    scorer = toxicity.fit(documents(spark, docs), labels)
    texts = [t for _, t in docs[:60]] + [None, "", "grimble", 'He said "grimble" once.', "“grymble snorpish” blatface grimble", prose(1, 20) + " snorpich " + prose(2, 5) + " blatface " + prose(3, 30) + " grimble"]
    entries = scorer.lexicon.entries

    def hit(word):
        w, found = toxicity.folded(word), []
        for t, (term, beginning) in enumerate(entries):
            for n in range(1, len(w) + 1) if beginning else [len(w)]:
                d = levenshtein(w[:n], term)
                if d == 0 or (d == 1 and len(term) >= toxicity.FUZZY):
                    found.append((d, t))
        return min(found, default=None)

    for text in texts:
        words = (text or "").split()
        f, hits = np.zeros(4), [(i, h) for i, w in enumerate(words) if (h := hit(w))]
        for i, (d, t) in hits:
            a, b = max(0, i - toxicity.WINDOW), i + toxicity.WINDOW + 1
            if toxicity.quoted(words[a:b], i - a, scorer.reporting):
                f[2] += scorer.value[d + 2 * t]
            else:
                f[d] += scorer.value[d + 2 * t]
                f[3] = max(f[3], sum(scorer.value[e + 2 * u] for k, (e, u) in hits if a <= k <= i))
        f = np.log1p(f)
        p = 1 / (1 + np.exp(-(scorer.weights[0] + f @ scorer.weights[1:])))
        assert scorer.score(pa.array([text], pa.string()))[0] == pytest.approx(p if f.any() else min(0.499, p)), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("'tis true you X ...", False), ('"yes" you X "ok"', False), ('he said "X" once', True), ('he said "you X there" once', True), ('("X!"), he said', True), ('you X "ok"', False), ('"ok" X', False),
        ("« X »", True), ("« ok » X", False), ("“you X”, she said", True), ("„X“ sagte er", True), ("don't X it's", False), ("'tis \"X\" he", True), ('X ... " !', False), ("‹ a › X ‹ b ›", False), ("「X」", True), ('" X "', False),
    ],
)
def test_quotation_marks_belong_together(text, want):
    words = text.split()
    assert toxicity.quoted(words, next(i for i, w in enumerate(words) if "X" in w)) == want


def test_reporting_words_are_learned(spark):
    docs, labels = labelled(spark)
    docs = [(i, f"{t} reportedly grimble {prose(i, 6)}" if i % 16 == 1 else t) for i, t in docs]
    scorer = toxicity.fit(documents(spark, docs), labels)
    assert "reportedly" in scorer.reporting and not scorer.reporting & set(WORDS)
    assert toxicity.fit(documents(spark, docs), labels.where("toxic = 1")).reporting == frozenset()


def test_equal_texts_with_both_labels_count_as_toxic(spark):
    docs, labels = labelled(spark)
    again = spark.createDataFrame([(5000 + i, 0) for i in range(0, 400, 4)], "doc_id long, toxic int")
    twice = documents(spark, docs + [(5000 + i, t) for i, t in docs if i % 4 == 0])
    both = labels.select("doc_id", "toxic").unionByName(again)
    one, two = toxicity.fit(twice, both), toxicity.fit(twice.repartition(7), both.repartition(5))
    assert one.lexicon.entries == two.lexicon.entries and ("grimble", False) in one.lexicon.entries and np.allclose(one.weights, two.weights)


def test_entries_that_begin_one_another():
    rng = np.random.default_rng(2)
    terms = list({("".join(rng.choice(list("ab"), int(rng.integers(3, 8)))), bool(rng.integers(0, 2))) for _ in range(200)})
    want = []
    for term, beginning in terms:
        if (not beginning and len(term) >= toxicity.FUZZY) or not any((b and term.startswith(w)) or (beginning and w.startswith(term)) for w, b in want if b or len(w) < toxicity.FUZZY):
            want.append((term, beginning))
    assert toxicity.chosen(terms) == sorted(want, key=lambda e: e[1])


def test_toxicity_without_a_class_or_rows(spark):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.classify(documents(spark, docs), labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.classify(documents(spark, []), labels.limit(0)).count() == 0


# -- op5 ------------------------------------------------------------------------------------------------


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_masks_cover_all_small_differences():
    m = simhash.masks(4)
    rng = np.random.default_rng(0)
    assert len(m) == 31 and min(x.bit_count() for x in m) >= 31
    for _ in range(3000):
        diff = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False))
        assert any(diff & x == 0 for x in m)


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash_components(spark, block):
    base = prose(11, 400).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in range(0, 400, 23)]
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(near)], *[(200 + i, prose(300 + i, 40)) for i in range(60)], (300, "ÄB Cd"), (301, "Äb cd"), (302, "äb cd")]
    docs = documents(spark, rows)
    got = collections.Counter(tuple(r) for r in simhash.near_duplicates(docs, block=block).collect())
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    name = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    assert got == collections.Counter((d, f"{fps[i]:016x}", name(i)) for i, (d, _) in enumerate(rows))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter(name(i) for i in {find(i) for i in range(len(rows))})


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001)], "u long, v long")
    roots = collections.defaultdict(set)
    for r in simhash.components(edges).collect():
        roots[r.root].add(r.node)
    assert sorted(map(len, roots.values())) == [2, 501]


def test_simhash_sends_no_table_through_the_driver(spark, monkeypatch):
    plans, stage = [], simhash.staged

    def told(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, *rest)

    monkeypatch.setattr(simhash, "staged", told)
    docs = documents(spark, [(i, prose(i % 9, 30)) for i in range(40)])
    out = [simhash.near_duplicates(docs), simhash.one_of_each(docs)]
    assert [df.count() for df in out] == [40, 9]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in out]
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not [p for p in plans if "Broadcast" in p]


def test_simhash_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# -- op6 and op9 ----------------------------------------------------------------------------------------


def vectors(spark, n=700, d=12):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((n, d)).astype(np.float32)
    x[100:160] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(10000, None), (10050, [0.0] * d), (10100, [float("nan")] * d), (10150, [float("inf")] + [0.0] * (d - 1)), (10200, [None] + [1.0] * (d - 1)), (None, [1.0] * d), (5, x[5].tolist())]
    return x, rows, spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows + odd], "vec_id long, embedding array<float>, part int, rank int, score double")


def test_exact_top_k(spark):
    x, rows, df = vectors(spark)
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    ids = [i for i, _ in rows] + [5]
    every = np.concatenate((q, q[5:6]))
    extra = {10050: np.zeros(12, np.int64)}
    ids, every = np.array([*ids, *extra]), np.concatenate((every, *[v[None] for v in extra.values()]))
    want = set()
    for i in [*range(0, 700, 50), 10050]:
        s = every @ (q[i] if i < 700 else extra[i])
        some = np.flatnonzero(ids != i)
        for r, k in enumerate(sorted(some, key=lambda k: (-s[k], ids[k]))[:5], 1):
            want.add((i, r, int(ids[k]), int(s[k])))
    base = kdtree.aliased(df, id="vec_id", v="embedding")
    base = base.where(base.id.isNotNull() & kdtree.usable(base.v)).withColumn("v", kdtree.quantised(base.v))
    got = kdtree.top_k(base, base.where("id % 50 = 0"), 5, shard_rows=100, block=4)
    assert {tuple(r) for r in got.collect()} == want
    assert {tuple(r) for r in kdtree.exact_search(df).collect()} == want
    assert kdtree.exact_search(df.where("vec_id < 3")).count() == 2 and kdtree.exact_search(df.limit(0)).count() == 0


def test_exact_top_k_of_many_copies(spark):
    v = np.random.default_rng(0).standard_normal((2, 8)).astype(np.float32)
    rows = [(50 * (i % 2), v[i % 2].tolist()) for i in range(18000)] + [(7, v[0].tolist())]
    got = {tuple(r) for r in kdtree.exact_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    a, b = int(q[0] @ q[0]), int(q[0] @ q[1])
    assert a > b and got == {(0, 1, 7, a), *[(0, r, 50, b) for r in range(2, 6)], *[(50, r, 0, b) for r in range(1, 6)]}


def test_exact_top_k_with_empty_shards(spark):
    x = np.random.default_rng(4).integers(-9, 9, (40, 3))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
    got = {tuple(r) for r in kdtree.top_k(base, base.where("id % 5 = 0"), 3, shard_rows=1, block=2).collect()}  # 40 parts for 40 rows: some get none
    want = set()
    for i in range(0, 40, 5):
        s = x @ x[i]
        want |= {(i, r, k, int(s[k])) for r, k in enumerate(sorted((k for k in range(40) if k != i), key=lambda k: (-s[k], k))[:3], 1)}
    assert got == want


def test_exact_top_k_of_large_values(spark):
    rng = np.random.default_rng(6)
    for scale in (1e4, 1e7, 1e10, 1e14, 1e200):
        rows = [(i, (rng.standard_normal(3) * (scale if i % 3 else 1)).tolist()) for i in range(200)]
        whole = {i: [int(np.clip(x * 256, -1e150, 1e150) // 1) for x in v] for i, v in rows}
        want = set()
        for i in range(0, 200, 50):
            s = {j: min(max(sum(a * b for a, b in zip(whole[i], whole[j], strict=True)), -kdtree.LARGEST), kdtree.LARGEST) for j in whole if j != i}
            want |= {(i, r, j, s[j]) for r, j in enumerate(sorted(s, key=lambda j: (-s[j], j))[:5], 1)}
        assert {tuple(r) for r in kdtree.exact_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want


@pytest.mark.parametrize("d", [12, 64])
def test_dimension_scan_of_clusters_probes_few_lists(spark, d):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((40, d))[rng.integers(0, 40, 2400)] + 0.2 * rng.standard_normal((2400, d))
    index = dimension_scan.Index(x, np.arange(2400), x[::20], np.arange(0, 2400, 20), 49, (x * x).sum(axis=1).max(), 20)
    assert index.probed < 25
    got = collections.defaultdict(set)
    for r in dimension_scan.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r.query_id].add(r.vec_id)
    hit = []
    for i in range(0, 2400, 20):
        s = x @ x[i]
        s[i] = -np.inf
        hit.append(len(got[i] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hit) >= 0.9


def test_dimension_scan_of_mixed_lengths_and_copies(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(8 if i % 40 else 4).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(3000)] + [(20, [0.5] * 4)]
    got = collections.defaultdict(list)
    for r in dimension_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    of = dict(rows) | {20: min(v for i, v in rows if i == 20)}
    for i, found in got.items():
        others = [j for j, v in rows if j != i and len(v) == len(of[i])]
        assert len(found) == min(20, len(others)) and all(j in set(others) for _, j, _ in found)
        assert all(any(abs(np.dot(of[i], v) - s) < 1e-9 for k, v in rows if k == j and len(v) == len(of[i])) for _, j, s in found)
        if len(others) < 20:
            continue
        best = sorted((float(np.dot(of[i], v)) for j, v in rows if j != i and len(v) == len(of[i])), reverse=True)[:20]
        assert np.isclose(sum(s for *_, s in found), sum(best), rtol=0.2)


def test_dimension_scan_recall(spark):
    x, rows, df = vectors(spark, 1500)
    got = collections.defaultdict(list)
    for r in dimension_scan.search(df, every=20, k=20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit, y = [], x.astype(np.float64)
    assert set(got) == set(range(0, 1500, 20))
    for i in got:
        s = y @ y[i]
        best = [k for k in sorted(range(1500), key=lambda k: (-s[k], k)) if k != i][:20]
        found = [v for _, v, _ in sorted(got[i])]
        assert len(found) == 20 and i not in found and all(abs(s[v] - sc) < 1e-9 for _, v, sc in got[i])
        assert [(-sc, v) for _, v, sc in sorted(got[i])] == sorted((-sc, v) for _, v, sc in got[i])
        hit.append(len(set(best) & set(found)) / 20)
    assert np.mean(hit) >= 0.9
    few = dimension_scan.search(df.where("vec_id < 5"), every=20, k=20)
    assert few.count() == 4
    assert dimension_scan.search(df.limit(0)).count() == 0


# -- op7 ------------------------------------------------------------------------------------------------


def test_source_mix(spark):
    rows = [(i, prose(i, 5 + i % 40), ["a", "b", "c", "d", None][i % 5 if i % 3 else 0]) for i in range(600)] + [(None, "x y", "b"), (1, None, "e"), (1, "", "e")]
    got = source_mix.mix_sizes(documents(spark, rows)).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    target |= share
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in order:
        assert by[size[s]][1] == pytest.approx(target[s])
        assert by[size[s]][0] == pytest.approx(target[s], rel=0.15, abs=5)
    assert spoken(got) == spoken(source_mix.mix_sizes(documents(spark, rows).repartition(7)).collect())
    mixed = source_mix.mix_documents(documents(spark, rows))
    assert mixed.columns == documents(spark, []).columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert source_mix.mix_sizes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7])
def test_source_mix_without_ids_of_its_own(spark, ids, monkeypatch):
    monkeypatch.setattr(source_mix, "ROWS", 100)
    texts = {"b": lambda i: "ten words of one text that all of these share", "c": lambda i: prose(i % 300, 10)}  # one text, and some texts with copies
    rows = [(ids(i), texts[s](i), s) for s in "bc" for i in range(1200)] + [(i, prose(i, 20), "a") for i in range(600)]
    table = documents(spark, rows)
    got = source_mix.mix_sizes(table).collect()
    assert len(got) == len(rows)
    taken, target = collections.Counter(), {}
    for r in got:
        taken[r.target] += r.taken
        target[r.target] = r.target
    assert len(target) == 3 and all(taken[t] == pytest.approx(t, rel=0.06) for t in target)
    assert spoken(got) == spoken(source_mix.mix_sizes(table.repartition(5)).collect())
    mixed = source_mix.mix_documents(table)
    assert mixed.columns == table.columns
    count = lambda rows: collections.Counter((r.source, len(r.text.split())) for r in rows)
    assert sum(k[1] * n for k, n in count(mixed.collect()).items()) == sum(taken.values())
    assert count(mixed.collect()) == count(source_mix.mix_documents(table.repartition(3)).collect())


# -- op8 ------------------------------------------------------------------------------------------------


def test_piece_codec(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = [*ODD, (20, "</s> <s> <unk> <0x41>"), (21, "▁a ▁▁b"), (22, "    deep\n        indent   "), (23, "▁ "), (24, " ▁"), (25, "a▁b c")]
    want = collections.Counter()
    for d, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), True] += 1
    assert collections.Counter(tuple(r) for r in piece_codec.digests(documents(spark, rows), P.path("piece_bpe_32k.model")).collect()) == want
    codec = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    assert [sp.id_to_piece(i) for i in codec.agenda("▁hello")] == sp.encode("hello", out_type=str)
    assert piece_codec.encode_documents(documents(spark, []), P.path("piece_bpe_32k.model")).count() == 0


MIXED = [" ", "▁", "\t", "\n", "\x00", "\u0301", "a", "é", "th", "the", "\u200d", "🙂", "漢", "\xa0", "\u3000", "<s>", "</s>", "1", "\x85", "▂", "<|endoftext|>", "<|", "|>", "'s", "  "]


def random_texts(seed: int, n: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(MIXED, int(rng.integers(0, 10)))) for _ in range(n)]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_piece_codec_encodes_random_texts_as_the_library_does():
    codec = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    texts = random_texts(4, 6000)
    for k in range(0, len(texts), 30):
        part = texts[k : k + 30]
        ids, counts, checked = codec.encode(pa.array(part))
        assert split(ids, counts) == codec.library.encode(part) and checked.all()


def test_piece_codec_follows_the_library_where_units_differ(monkeypatch):
    codec = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    monkeypatch.setattr(piece_codec, "spaced", lambda raw, offsets: (raw, offsets))  # as if a cut were wrong
    part = ["▁ ", "plain words", "", "x ▁▁ ▁"]
    ids, counts, checked = codec.encode(pa.array(part))
    assert split(ids, counts) == codec.library.encode(part) and checked.tolist()[:3] == [False, True, True]


def test_caches_forget_rare_units():
    from paperloom.llm.shared import UnitCache

    asked = []
    cache = UnitCache(lambda units: asked.extend(units) or [np.array([int(u), 1], np.uint32)[: 1 + int(u) % 2] for u in units], limit=10)
    rng = np.random.default_rng(8)
    for _ in range(60):
        numbers = [0, 1, 2, *rng.integers(3, 200, 6).tolist()]
        units = [f"{k:03}" for k in numbers]
        raw = np.frombuffer("".join(units).encode(), np.uint8)
        ids, counts = cache.ids(raw, np.array([0, len(raw)]), np.arange(0, len(raw), 3))
        assert ids.tolist() == [x for k in numbers for x in [k, 1][: 1 + k % 2]] and counts.tolist() == [len(ids)]
    assert all(asked.count(f"{k:03}") == 1 for k in range(3))


# -- op10 -----------------------------------------------------------------------------------------------


def removed(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        drop = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                drop[i : i + window] = True
        kept = b" ".join(x for x, y in zip(w, drop, strict=True) if not y)
        out.append((d, len(w), int(drop.sum()), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("bucket", [1 << 25, 5000])
def test_substring_dedup(spark, monkeypatch, bucket):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    shared, line = prose(50, 60), prose(51, 12)
    rows = [*ODD, (70, prose(3, 30000)[9000:60000]), *[(100 + i, f"{prose(400 + i, 30)} {shared} {prose(500 + i, 30)}") for i in range(6)], (120, " ".join([line] * 20)), (121, prose(52, 34)), (122, prose(52, 34)), (123, prose(53, 35)), (124, prose(53, 35)), (125, "a " * 100)]
    got = collections.Counter(tuple(r) for r in substring_dedup.digests(documents(spark, rows)).collect())
    assert got == removed(rows, 35)
    kept = substring_dedup.without_repeats(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    clean = {r.doc_id: r.text for r in kept.collect()}
    assert clean[121] == prose(52, 34) and clean[123] == "" and clean[1] is None and clean[9] == "w" * 20000
    assert substring_dedup.digests(documents(spark, [])).count() == 0


def rounds(tasks, window, folder):
    """Words that stay of every text, by the operator's rounds without Spark; a task is a list of (chunk, texts)."""
    read = lambda task: [pa.RecordBatch.from_arrays([pa.array([c] * len(texts), pa.int32()), pa.array(texts, pa.string())], ["_chunk", "text"]) for c, texts in task]

    def dealt(told):
        rows = sorted((r for batch in told for r in batch.to_pylist()), key=lambda r: (r["bucket"], r["kind"]))
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        return iter([pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(["bucket", "chunk", "kind", *"abcd"], kinds, strict=True))))])

    def filed(answers, name):
        rows = [r for batch in answers for r in batch.to_pylist()]
        for i, r in enumerate(rows):
            (folder / name / f"chunk={r['chunk']}").mkdir(parents=True, exist_ok=True)
            pq.write_table(pa.table({k: pa.array([r[k]], pa.binary()) for k in "abc"}), folder / name / f"chunk={r['chunk']}" / f"{i}.parquet")
        return str(folder / name), rows

    s = substring_dedup
    first, _ = filed(s._repeated(dealt(b for t in tasks for b in s._counts(window, 4, None, iter(read(t))))), "repeated")
    second, claims = filed(s._claimed(dealt(b for t in tasks for b in s._counts(window, 4, first, iter(read(t))))), "claimed")
    sent = [b for t in tasks for b in s._contents(window, 4, first, second, iter(read(t)))]
    claimed = pa.RecordBatch.from_pylist([{**r, "kind": 0, "d": None} for r in claims])
    third, _ = filed(s._indexed(window, dealt([claimed, *sent])), "masks")
    return [s.kept(p, s.covered(p, s.beside(first, c), s.beside(third, c)))[0] for t in tasks for c, _, p in s._pieces(iter(read(t)), window)]


@pytest.mark.parametrize("hot", [256, 2])
def test_contents_told_in_parts(monkeypatch, tmp_path, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    shared = [prose(80 + i, 60) for i in range(12)]
    texts = [f"{prose(600 + i, 30)} {shared[i % 12]} {prose(700 + i, 30)}" for i in range(36)]
    one = [[(k, [t]) for t in texts[k * 18 : k * 18 + 18]] for k in (0, 1)]
    want = rounds(one, 20, tmp_path / "whole")
    assert all(x not in w.decode() for x in shared for w in want)
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 50)
    assert rounds(one, 20, tmp_path / "cut") == want  # an index a few contents
    monkeypatch.setattr(substring_dedup, "HELD", 5)
    assert rounds(one, 20, tmp_path / "flushed") == want  # a chunk's keys in several rows
    assert rounds([[(0, [t]) for t in texts[:20]], [(0, [t]) for t in texts[20:]]], 20, tmp_path / "split") == want  # a chunk read by two tasks


def test_columns_with_the_operators_own_names(spark):
    rows = [(1, prose(60, 80)), (2, prose(60, 80)), (3, prose(61, 80))]
    docs = documents(spark, rows).selectExpr("*", "1 as _chunk", "2 as _row", "3 as _rate", "4 as _copy", "'own' as _source")
    for out, ids in ((substring_dedup.without_repeats(docs), {1, 2, 3}), (simhash.one_of_each(docs), {1, 3}), (source_mix.mix_documents(docs), None)):
        got = out.collect()
        assert out.columns == docs.columns and all((r._chunk, r._row, r._rate, r._copy, r._source) == (1, 2, 3, 4, "own") for r in got)
        assert ids is None or {r.doc_id for r in got} == ids


def test_index_counts_windows_like_a_dictionary():
    rng = np.random.default_rng(1)
    for _ in range(40):
        window, k = int(rng.integers(2, 9)), int(rng.integers(1, 30))
        length, weight = rng.integers(window, window + 20, k), rng.integers(1, 3, k)
        words = rng.integers(0, 3, length.sum()).astype(np.uint64)
        masks = substring_dedup.repeated_windows(words, length, weight, window)
        begin, count = np.cumsum(length) - length, collections.Counter()
        window_at = lambda i, j: tuple(words[begin[i] + j : begin[i] + j + window])  # noqa: B023, E731
        for i in range(k):
            for j in range(length[i] - window + 1):
                count[window_at(i, j)] += weight[i]
        assert masks.tolist() == [sum(1 << j for j in range(length[i] - window + 1) if count[window_at(i, j)] > 1) for i in range(k)]


# -- all ------------------------------------------------------------------------------------------------


def test_empty_tables_give_no_rows(spark):
    none = documents(spark, [])
    model = P.path("piece_bpe_32k.model")
    for found in (license_scan.scan(none), piece_codec.digests(none, model), substring_dedup.digests(none), substring_dedup.without_repeats(none), source_mix.mix_documents(none), simhash.one_of_each(none)):
        assert found.collect() == []
