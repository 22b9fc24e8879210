import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from millrace.llm import divergence, language_id, prefix_trie, queries

DOCS = "doc_id long, text string, lang string, source string"


# ---- language identification


def plain_grams(text):
    """n-grams of 1 to 3 letters and gaps, none with two gaps in a row and no lone gap."""
    marked = [c.lower() if len(c.lower()) == 1 else c for c in text]
    marked = [" ", *[m if c.isalpha() else " " for m, c in zip(marked, text, strict=True)], " "]
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            gram = "".join(marked[i : i + n])
            if gram != " " and "  " not in gram:
                yield gram


def plain_bucket(gram, bits):
    total = sum(ord(c) * int(m) for c, m in zip(reversed(gram), language_id._MULTIPLY, strict=False)) ^ (len(gram) - 1)
    return (((total % 2**64) ^ 0) * int(language_id._MULTIPLY[0])) % 2**64 >> (64 - bits)


LANG_ROWS = [
    (1, "the cat sat on the mat and the dog", "en", "a"), (2, "le chat est sur la table et le chien", "fr", "a"), (3, "der Hund ist auf dem Tisch, straße", "de", "a"),
    (4, "the dog and the cat", "en", "a"), (6, "un chien et un chat", "fr", "b"), (7, "ÉTÉ à la plage", "fr", "b"), (7, "ÉTÉ à la plage", "fr", "b"), (8, None, "en", "b"), (9, "", "de", "b"),
    (11, "12 34 !!", "en", "b"), (12, "the unknown", None, "c"), (None, "the cat again", "xx", "c"), (13, "x" * 300, "", None), (14, "der Hund " * 5, "de", None),
]


def plain_model(rows, bits):
    learned = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    counts, texts = defaultdict(Counter), Counter()
    for _, text, lang, _ in learned:
        texts[lang] += 1
        counts[lang].update(plain_bucket(g, bits) for g in plain_grams(text))
    return counts, texts


def test_language_against_plain_bayes(spark):
    model = language_id.train(spark.createDataFrame(LANG_ROWS, DOCS))
    counts, texts = plain_model(LANG_ROWS, model.bits)
    assert model.langs == sorted(texts) and "xx" not in model.langs and "" in model.langs
    size = 1 << model.bits
    want = {}
    for doc, text, _, _ in LANG_ROWS:
        if not any(c.isalpha() for c in text or ""):
            want[doc] = ("und", 0.0)
            continue
        odds = {}
        for lang in texts:
            total = sum(counts[lang].values()) + language_id.ALPHA * size
            odds[lang] = math.log(texts[lang] / sum(texts.values())) + sum(math.log((counts[lang][plain_bucket(g, model.bits)] + language_id.ALPHA) / total) for g in plain_grams(text)) / 3
        best = max(odds, key=odds.get)
        want[doc] = (best, 1 / sum(math.exp(v - odds[best]) for v in odds.values()))
    for r in language_id.identified(spark.createDataFrame(LANG_ROWS, DOCS)).collect():
        assert r.lang_pred == want[r.doc_id][0] and abs(r.score - want[r.doc_id][1]) < 1e-4, r
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_long_text_in_pieces_counts_each_gram_once(monkeypatch):
    text = "Der große Hund, 12 Katzen und Ärger  " * 40
    count = lambda: Counter(i for points, _, _, new in language_id._pieces([text, "ab", ""]) for _, ids in language_id._grams(points, new, 20) for i in ids.tolist())
    whole = count()
    assert sum(whole.values()) == len(list(plain_grams(text))) + len(list(plain_grams("ab")))
    for piece in (7, 64, 1000):
        monkeypatch.setattr(language_id, "PIECE", piece)
        assert count() == whole


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) and (got.lang == got.lang_pred).mean() >= 0.97 and got.score.between(0, 1).all()


def test_language_does_not_read_the_answer(spark):
    """Other values of lang, source and doc_id in the rows to be judged change nothing."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train(docs)
    one = language_id.identify(docs.select("text"), model).orderBy("text", "lang_pred").collect()
    two = language_id.identify(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(5)), model).select("text", "lang_pred", "score").orderBy("text", "lang_pred").collect()
    assert one == two


def test_language_edges(spark):
    empty = spark.createDataFrame([], DOCS + ", score double")
    assert language_id.identified(empty).count() == 0
    nothing = language_id.identified(spark.createDataFrame([(1, "hello", None, "a"), (5, None, "en", "a")], DOCS)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    with pytest.raises(ValueError, match="score"):
        language_id.identify(empty, language_id.train(empty))


# ---- source divergence


def plain_audit(rows, min_docs):
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n.update((lang, source, t) for t in terms)
        docs.update({(lang, t) for t in terms})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (l, t), c in docs.items() if l == lang and c >= min_docs), key=str.encode)
        sources = [s for l, s in groups if l == lang]
        v = len(kept)

        def shares(count):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 2) // (total + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own = {s: shares(lambda t: n[lang, s, t]) for s in sources}
        whole = shares(lambda t: sum(n[lang, s, t] for s in sources))
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            told = [(-f(own[s][t], whole[t]), t.encode(), t) for t in kept if n[lang, s, t] > 0 and own[s][t] > whole[t]]
            out += [(lang, s, "pair", o, -value, k) for k, (value, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -value, k) for k, (value, _, t) in enumerate(sorted(told)[:10], 1)]
    return sorted(out)


def audited(df, **how):
    return sorted(map(tuple, divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize(("band", "block"), [(48, 512), (2, 3), (3, 1)])
def test_divergence_against_brute_force(spark, band, block):
    rng = random.Random(4)
    words = ["Ab", "ab", "é", "É", "zz-top", "x_y", "naïve", "😀", "q1r", "The", "the", "of"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "é", None, "s4", "s5", "S1"])) for _ in range(160)]
    rows += [(None, "de", "alone"), ("rare words here", "xx", "a"), ("", "xx", "b"), ("a a a", "yy", "one")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for least in (3, 10):
        assert audited(df, min_docs=least, band=band, block=block) == plain_audit(rows, least)


def test_divergence_long_texts_and_edges(spark):
    assert [t for part in divergence._terms("Ab cd Éf gh ij", 8) for t in part] == [b"ab", b"cd", "Éf".encode(), b"gh", b"ij"]
    rows = [(f"Alpha beta{'x' * i} gamma, delta; " * 40_000, "en", f"s{i % 3}") for i in range(12)]
    schema = "text string, lang string, source string, n long, docs string, value string, part string"
    assert audited(spark.createDataFrame([(*r, 1, "d", "v", "p") for r in rows], schema), min_docs=2) == plain_audit(rows, 2)
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = np.random.RandomState(1)
    counts = rng.randint(0, 1 << 45, 200)
    total, terms = int(counts.sum()), 200
    assert divergence.shares(counts, np.array(total), terms).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * terms) for c in counts]


# ---- prefix trie


def plain_trie(convs):
    """convs: [(conv_id, [(turn, words)])]."""
    members, words = defaultdict(list), {(): 0}
    for c, seq in convs:
        for d in range(len(seq) + 1):
            members[tuple(t for t, _ in seq[:d])].append(c)
            if d:
                words[tuple(t for t, _ in seq[:d])] = seq[d - 1][1]
    ends = defaultdict(list)
    for c, seq in convs:
        ends[tuple(t for t, _ in seq)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words[p]
            leaves[p[:d]] += not kids[p]
    said = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), kids[p], leaves[p], saved[p], said(p)) for p, m in members.items())


def as_trie(df):
    return sorted((r.conv_id, r.depth, -99 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def sequences(kind, rng):
    long = [rng.randint(0, 2) for _ in range(40)]
    if kind == "nested":
        return [long[:k] for k in range(41)] + [long[:k] + [9] for k in range(0, 40, 3)]
    if kind == "copies":
        return [long[:7]] * 60 + [long[:3]] * 5 + [[8, 8]]
    if kind == "chain":
        return [[1, 2, 3, 4]]
    if kind == "one first turn":
        return [[5, *(rng.randint(0, 3) for _ in range(rng.randint(0, 5)))] for _ in range(90)]
    return [[rng.randint(0, 2) for _ in range(rng.randint(0, 6))] for _ in range(150)]


@pytest.mark.parametrize("kind", ["random", "nested", "copies", "chain", "one first turn"])
def test_trie_against_brute_force(spark, kind):
    rng = random.Random(kind)
    found = sequences(kind, rng)
    ids = rng.sample(range(-50, 1000), len(found))
    digest = lambda t: hashlib.sha256(str(t).encode()).hexdigest()[:32]
    convs = list(zip(ids, found, strict=True))
    df = spark.createDataFrame([(c, [digest(t) for t in seq], [t % 4 for t in seq]) for c, seq in convs], "conv_id long, digests array<string>, words array<long>")
    want = plain_trie([(c, [(t, t % 4) for t in seq]) for c, seq in convs])
    for blocks in (1, 7, 40):
        assert as_trie(prefix_trie.trie(df, blocks)) == want


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {}
    for c, said in turns.items():
        digest = lambda x: hashlib.sha256(f"{len(x[0])}:{x[0]}{x[1]}".encode()).hexdigest()[:32]
        own[c] = [x for _, x in sorted(said, key=lambda s: (s[0], digest(s[1])))]
    out = []
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        out.append((c, [(x, len(re.findall(r"[^\x20\x09-\x0D]+", x[1]))) for x in own.get(base, [])[:h] + seq[h:]]))
    return out


def test_whole_operator_with_odd_rows(spark):
    rng = random.Random(8)
    say = ["hi there", "", None, "a  b\tc\n", "é ü", "hi  there", "nbsp　x", "z" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(say)) for c in [*range(1, 90), -7, -20, 10**12 + 3] for t in rng.sample([None, 0, 1, 2, 3, 4], rng.randint(1, 4))]
    rows += [(None, 0, "user", "hi"), (5, 0, "user", "same"), (5, 0, "user", "same"), (41, 1, "tool", "tie"), (41, 1, "tool", "other tie")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digests string, block int")
    got = as_trie(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(df)), 9))
    assert got == plain_trie(plain_rebuilt(rows))
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)  # turnless conversations end at the root


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(none))).count() == 0
    assert rows_of(queries.op13_prefix_trie(spark, SMALL))[1]
