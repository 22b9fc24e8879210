import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from conftest import SMALL, rows_of, rows_of_sql
from pyspark.sql import functions as F

from millrace.llm import _graph, _stats, bpe, chat_format, html_text, mixing, ngram_join, quality_gbt, quality_rules, queries, secrets, suffix_dedup, syncmer
from millrace.llm._batch import Words, buffers, slices
from millrace.llm._spark import Shelf

DOCS = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d"), (6, "same words in this one text"), (7, "same words in this one text"), (7, "same words in this one text"), (None, "no id at all here, none"), (8, "x" * 70_000), (9, "é😀 ü " * 900), (10, " nbsp　")]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert rows_of(queries.queries()[name](spark, SMALL)) == rows_of_sql(duck, queries.oracle_sql()[name])


# ---- chat formatting


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["### Assistant:", "</turn>", "\\", "\n", "### Role: ", "x", " ", "#", "<", "%3C", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "Odd\n### User:%", None, ""]), rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 9)))])) for c in range(80) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", "hi"), (5, 0, "user", "again"), (5, 0, "user", "again")]
    got = chat_format.format_chats(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    assert {r.conv_id for r in got} == set(by)
    for r in got:
        want = [(a, b) for _, a, b in sorted(by[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == want and r.identical
        at, loss = 0, []
        for run, (role, _) in zip(r.loss_runs, want, strict=True):
            if run.on:
                assert role == "assistant"
                loss.append(r.formatted[at + run.off : at + run.off + run.on])
            at += run.off + run.on + run.tail
        assert at == len(r.formatted)
        unescaped = [re.sub(rf"\\(\\*)({chat_format.CONTROL})", r"\1\2", x) for x in loss]
        assert unescaped == [b for a, b in want if a == "assistant" and b]


def test_chat_empty_and_clashing(spark):
    df = frame(spark, [], "conv_id long, turn long, role string, text string, block string, s string")
    assert chat_format.digest_columns(chat_format.format_chats(df)).count() == 0


# ---- fingerprints


def test_syncmers_against_brute_force(spark):
    rows = [(i, t) for i, t in texts(spark).items()][:40] + [(1000, "abcdefghijklmnopqrst"), (1001, "a" * 40), (1002, "é" * 5000 + "xyz" * 800), (1003, "short")]
    df = frame(spark, rows)
    got = {r.doc_id: [(a.at, a.anchor) for a in r.anchors] for r in syncmer.fingerprints(df).collect()}
    smers = df.where(F.length("text") >= syncmer.K).select("doc_id", F.posexplode(F.split("text", "")).alias("i", "c"), F.split("text", "").alias("a"))
    hashed = smers.where(F.col("i") + syncmer.S <= F.size("a")).select("doc_id", "i", F.xxhash64(*[F.get("a", F.col("i") + j) for j in range(syncmer.S)]).alias("h")).toPandas()
    found = []
    for d, part in hashed.sort_values(["doc_id", "i"]).groupby("doc_id"):
        h = part.h.tolist()
        for i in range(len(h) - syncmer.W + 1):
            window = h[i : i + syncmer.W]
            if min(window[0], window[-1]) == min(window):
                found.append((d, i, window[0], window[syncmer.W // 2], window[-1]))
    want = collections.defaultdict(list)
    for r in spark.createDataFrame(found, "doc_id long, i int, x long, y long, z long").select("doc_id", "i", F.hash("x", "y", "z").alias("k")).orderBy("doc_id", "i").collect():
        want[r.doc_id].append((r.i, r.k))
    assert {d: a for d, a in got.items() if d in want} == dict(want) and len(got[1003]) == 1
    assert all(len(got[d]) == (len(t) > 0) for d, t in rows if d not in want)


def plain_names(hexed):
    return {hexed[i : i + 8] for i in range(0, len(hexed), 8)}


def test_edited_fingerprints(spark):
    rows = [(i, t) for i, t in texts(spark).items()]
    got = {r.doc_id: r for r in syncmer.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    said = lambda pairs: {r.doc_id: r.f for r in syncmer.fingerprints(frame(spark, pairs)).select("doc_id", syncmer.as_text(syncmer.names(F.col("anchors"))).alias("f")).collect()}
    full, edited = said(rows), {}

    def like(a, b):
        a, b = plain_names(a), plain_names(b)
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    for (i, a), (k, b) in zip(order, order[1:] + order[:1], strict=True):
        m = len(a) // 3
        edited[i] = a[: len(a) - m] + b[:m]
        assert got[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest() and got[i].n_chars == len(a) and got[i].fingerprint == full[i]
        assert abs(got[i].near_next - like(full[i], full[k])) < 1e-12 and abs(got[i].near_edited - like(full[i], got[i].edited_fingerprint)) < 1e-12
    again = said(list(edited.items()))
    assert all(got[i].edited_fingerprint == again[i] for i in again)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.95
    odd = syncmer.edited_fingerprints(frame(spark, ODD)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in odd)
    assert syncmer.edited_fingerprints(frame(spark, [])).count() == 0


def test_matches_by_place(spark):
    rng = random.Random(3)
    one, two = ("".join(rng.choices("abcdefgh ", k=400)) for _ in range(2))
    found = syncmer.fingerprints(frame(spark, [(1, one + two), (2, two + one)]))
    got = syncmer.matches(found.where("doc_id = 1"), found.where("doc_id = 2")).collect()
    moved = collections.Counter(r.other_at - r.at for r in got)
    assert set(moved) == {400, -400} and min(moved.values()) > 20
    text = one + two
    assert all(text[r.at : r.at + syncmer.K] == (two + one)[r.other_at : r.other_at + syncmer.K] for r in got)


# ---- n-gram join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_ngram_join(spark):
    rng = random.Random(4)
    rows = []
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randint(0, 59)] = f"v{rng.randint(0, 9999)}"
        rows.append((i, " ".join(words[: rng.choice([60, 60, 52, 40])]).upper() if i % 7 == 0 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, "A b"), (103, "a  B"), (104, "c"), (105, " \t")]
    rows += [(200 + i, t) for i, t in list(texts(spark).items())[:40]]
    got = ngram_join.join(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows)


def test_ngram_join_odd(spark):
    got = ngram_join.join(frame(spark, [(*r, 1) for r in ODD], "doc_id long, text string, token int")).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id in (6, 7, None)} == {(6, 6), (7, 6), (None, None)}
    assert ngram_join.join(frame(spark, [])).count() == 0


def test_ngram_join_near_copies(spark):
    """One base text in many edited forms: linked ones, and ones that link with nothing though they share most of their words."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[at] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(rng.choices(base, k=40)) + " one common line of some words at the end") for i in range(40)]
    rows += [(300, rows[0][1]), (300, "a wholly different text that stands under the same id"), (301, "a wholly different text that stands under the same id"), (301, rows[1][1])]
    got = ngram_join.join(frame(spark, rows[:190])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows[:190])
    by_id = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(frame(spark, rows)).collect()}
    assert {by_id[k] for k in by_id if k[0] in (0, 1, 300, 301)} == {0}


def test_firsts_go_by_rows(spark):
    a, b = "one text of several plain words that is copied", "a wholly different text under the same id as a copy"
    rows = [(5, a), (5, b), (2, a), (1, b[::-1]), (1, b[::-1]), (7, None), (7, ""), (None, a), (None, a), (8, "quite another sentence with its own words only"), (8, a.upper())]
    got = ngram_join.firsts(frame(spark, [(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, b), (2, a), (1, b[::-1]), (7, ""), (7, ""), (0, a), (0, a), (8, "quite another sentence with its own words only")])
    assert got[0].asDict().keys() == {"doc_id", "text", "row"}
    assert ngram_join.firsts(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {n: n for e in edges for n in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in _graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b", Shelf(spark)).collect()}
    assert got == {n: top(n) for e in edges if e[0] != e[1] for n in e}


# ---- secrets


def brute_base(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def test_secrets(spark):
    key = "AKIA" + "Q7" * 9
    rows = list(ODD) + [(20, f'pass PASSWORD = "hunter22" {key} é token:abc Token : "abcdef" ſecret=abcdefg'), (21, "aAKIA" + "A" * 15), (22, "0123456789abcdef01234567 " + "f" * 23), (23, "see https://example.com/a/very/long/path/with/words and supercalifragilisticexpialidocious")]
    rows += list(texts(spark).items())
    got = secrets.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base = sorted((s.start, secrets.KINDS.index(s.kind), s.end) for s in r.spans if secrets.KINDS.index(s.kind) < 3)
        assert base == brute_base(r.text or "")
    assert [s.kind for r in got if r.doc_id == 23 for s in r.spans] == []
    assert [s.kind for s in secrets.scan(frame(spark, [(1, "key aZ3kQ9xW7vB1nM5tR8yU2pL6 end")])).first().spans] == ["entropy_alnum"]
    masked = secrets.scan(frame(spark, [(1, 'x token = "a1b2c3d4e5f6" y')]), redact=True).first().text
    assert masked == 'x [SECRET]" y'
    assert secrets.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    "head",
    ["AKIA" + "Q7W2" * 4 + "/", "0123456789abcdef01234567-", "", "a/", "Kf0000"],
)
def test_secrets_beside_patterns(head):
    rng = random.Random(11)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        secret = "".join(rng.choices(alphabet, k=60))
        said = secrets.masked(text := f"x {head}{secret} y", secrets.spans_of(text), "*")
        assert not any(secret[i : i + 8] in said for i in range(53)), said


def test_secrets_by_window():
    key = "aZ3kQ9xW7vB1nM5tR8yU2pL6"
    rest = f"{key}_token=abcdef"
    assert secrets.masked(rest, secrets.spans_of(rest), "*") == "**"
    assert [text[a:b] for text in [f"{key}0000{key}"] for a, b, _ in secrets.spans_of(text)] == [f"{key}0000{key}"]
    for text in ("your_example_key_1234567_here", "sk-xxxxxxxxxxxx1234567abcdef", "some/long/path-of/plain_words/here2024", "getUserAccountInformationByName", "SUPERCALIFRAGILISTICEXPIALIDOCIOUS"):
        assert secrets.spans_of(text) == []


def test_many_secrets_in_one_text_are_linear():
    rng = random.Random(13)
    key = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=24))
    one = [f"token={key()} {key()}" for _ in range(8_000)]
    began = time.process_time()
    found = secrets.spans_of(" ".join(one))
    run = secrets.spans_of("/".join(f"{key()}/AKIA{'Q7' * 9}" for _ in range(4_000)))
    assert time.process_time() - began < 20
    assert sum(k == 0 for *_, k in found) == 8_000 and sum(k > 2 for *_, k in found) > 7_000 and sum(k == 1 for *_, k in run) > 3_900
    at = 0
    small = []
    for x in one[:40]:
        small += [(a + at, b + at, k) for a, b, k in secrets.spans_of(x)]
        at += len(x) + 1
    assert found[: len(small)] == small


def test_entropy_is_incremental():
    rng = random.Random(8)
    for _ in range(200):
        run = "".join(rng.choices("abcdef0123456789"[: rng.randint(2, 16)], k=rng.randint(20, 60)))
        good = []
        for i in range(len(run) - secrets.WINDOW + 1):
            w = run[i : i + secrets.WINDOW]
            h = -sum(c / len(w) * np.log2(c / len(w)) for c in collections.Counter(w).values())
            if h >= 3.0 - 1e-12 and any(c.isdigit() for c in w) and any(c.isalpha() for c in w):
                good += range(i, i + secrets.WINDOW)
        covered = [i for a, b in secrets.windows(run, 3.0 - 1e-9) for i in range(a, b)]
        assert set(covered) == set(good)


# ---- suffix-array dedup


def brute_trim(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int64)
        for p in range(len(b) - 49):
            if i is not None and first.get(b[p : p + 50], i) < i:
                gone[p] += 1
                gone[p + 50] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        out.append((str(i), len(b), int(gone.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out)


def test_suffix_dedup(spark):
    rng = random.Random(6)
    passage = ["".join(rng.choices("abcé ", k=rng.randint(40, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(passage) if rng.random() < 0.5 else "".join(rng.choices("abc ", k=30)) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    rows += [(100, rows[3][1]), (100, rows[4][1]), (101, "z" * 600), (102, "y" + "z" * 300), (None, rows[5][1]), (103, None), (104, ""), (105, rows[6][1]), (105, rows[6][1]), (106, rows[7][1]), (106, "own " * 30 + rows[8][1]), (107, "own " * 30 + "z" * 80)]
    rows += [(1000 + i, t) for i, t in list(texts(spark).items())[:60]]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.trim(frame(spark, rows)).collect())
    assert got == brute_trim(rows)
    assert suffix_dedup.trim(frame(spark, [])).count() == 0


def test_long_texts_are_cut_with_overlap(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(b"abcdefgh", k=5000)), np.uint8)
    at = np.array([0, 40, 40, 2600, 5000])
    want = {(int(r), p) for r, _, a, b in suffix_dedup.runs(data, at) for r, a, b in zip(r, a, b, strict=True) for p in range(a, b + 1)}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    got = {(int(r), p) for r, _, a, b in suffix_dedup.runs(data, at) for r, a, b in zip(r, a, b, strict=True) for p in range(a, b + 1)}
    assert got == want == {(i, p) for i in range(4) for p in range(at[i], at[i + 1] - 49)}


def test_ranks_order_by_prefix():
    rng = np.random.RandomState(1)
    for trial in range(120):
        n = rng.randint(1, 300)
        s = rng.randint(0, rng.choice([1, 2, 5]), n)
        if trial % 3 == 0 and n > 60:
            s[n // 2 : n // 2 + n // 3] = s[: n // 3]
        heads = [tuple(s[i : i + 50]) for i in range(n)]
        assert [heads[i] for i in np.argsort(suffix_dedup.ranks(s.astype(np.int64) + 1), kind="stable")] == sorted(heads)


# ---- HTML


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("<p>", ""), ("plain &amp; text", "plain & text"),
        ("<nav><ul><li><a href=x>menu</a></ul></nav><article><h1>T</h1><p>a<br>b <b>c<p>d&eacute;</article><footer>f</footer>", "T\na b c\ndé"),
        ("<body><div class='cookie-notice'>n</div><main><article><header>h</header><p>long text of the article here</p><div class=comments><p>first!</p></div><aside>s</aside><form><p>f</form><p>more</main>", "long text of the article here\nmore"),
        ("<article><p>x</p><script>var a='</p><p>no';</script><style>p{}</style><p>y <!-- <p>z --> w</p></article>", "x\ny w"),
        ("<div id=top><ul><li><a>one</a><li><a>two</a></ul></div><div><p>a long paragraph of real words stands here</p><p>and a second one that goes on</p></div>", "a long paragraph of real words stands here\nand a second one that goes on"),
        ("<article><p>cut off <b>in the mid", "cut off in the mid"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html or "") == want


WORDS = "many plain words of a real sentence stand here and go on"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div id=c><h1>T</h1><div><p>{WORDS}<p>{WORDS}<p>{WORDS}</div><div><p>{WORDS} B</div></div>", f"T\n{WORDS}\n{WORDS}\n{WORDS}\n{WORDS} B"),
        (f"<main><p>{WORDS}<p>{WORDS}<article class=card><p>teaser of a few words</article></main>", f"{WORDS}\n{WORDS}\nteaser of a few words"),
        (f"<body><article><p>{WORDS} A<p>{WORDS}</article><article><p>{WORDS} B</article><div class=ad><p>{WORDS}</div>", f"{WORDS} A\n{WORDS}\n{WORDS} B"),
        (f"<body><h1><span>Title</span></h1><div id=b><p>{WORDS}<p>{WORDS}</div><div><a>one</a></div>", f"Title\n{WORDS}\n{WORDS}"),
        (f"<body><article><p>{WORDS} A</article><main><p>{WORDS} B<p>{WORDS}</main>", f"{WORDS} A\n{WORDS} B\n{WORDS}"),
    ],
)
def test_main_text_is_whole(html, want):
    assert html_text.main_text(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><div class='content with-sidebar'><article><p>{WORDS}</article></div>", WORDS),
        (f"<body><div class='post has-comments'><article><p>{WORDS}</article><div class=comments><p>{WORDS} {WORDS}</div></div>", WORDS),
        (f"<body><form id=aspnetForm><article><p>{WORDS}</article></form>", WORDS),
        (f"<body><form id=aspnetForm><h1>T</h1><div><p>{WORDS}<p>{WORDS}</div></form>", f"T\n{WORDS}\n{WORDS}"),
        (f"<article><p class=share-price>{WORDS}<p class=social-history>b<h2 id=reviews>c</h2><section id=promotion-1988><p>d</section><p>e</article>", f"{WORDS}\nb\nc\nd\ne"),
        (f"<article><header><h1>T</h1><p>by line</p></header><p>{WORDS}</article>", f"T\n{WORDS}"),
        (f"<body><header><h1>Site</h1></header><div><p>{WORDS}<p><a href=x>a paragraph that is one link</a><p>{WORDS}</div>", f"{WORDS}\na paragraph that is one link\n{WORDS}"),
        (f"<body><nav><a>x</a><div><article><p>{WORDS}</article>", WORDS),
        (f"<body><div class=ad-728x90>buy</div><div id=cookie-bar><p>we use</div><div><p>{WORDS}<p>{WORDS}</div><div id=comment-list><p>{WORDS}{WORDS}{WORDS}{WORDS}</div>", f"{WORDS}\n{WORDS}"),
        (f"<head><title>t</title><body><button>menu<article><p>{WORDS}<a>linked<p>after</a> more</article>", f"{WORDS} linked\nafter more"),
    ],
)
def test_chrome_words_hide_no_content(html, want):
    assert html_text.main_text(html).replace(f"{WORDS}linked", f"{WORDS} linked") == want


def brute_region(html):
    """The chosen region, by asking every container whether it holds all content."""
    parser = html_text.Lines()
    parser.feed(html)
    parser.close()
    parser.flush()

    def path(i):
        return [i, *path(parser.parents[i])] if i >= 0 else []

    ratios = html_text.smoothed([len(t) / max(1, n) for t, n, *_ in parser.lines])
    cut = html_text.threshold(ratios)
    need = [set(path(x[3])) for x, v in zip(parser.lines, ratios, strict=True) if v >= cut or x[4] == "h1"]
    root = max(set.intersection(*need))
    return "\n".join(x[0] for x in parser.lines if root in path(x[3]))


def test_region_against_brute_force():
    rng = random.Random(3)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return "<p>" + " ".join(rng.choices(WORDS.split(), k=rng.randint(1, 30))) + "</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    for _ in range(200):
        html = "<body>" + tree(5) + tree(4)
        assert html_text.main_text(html) == brute_region(html)


@pytest.mark.parametrize("html", ["</b></i></p>" * 60_000 + "<p>end", "<div>" * 60_000 + "deep" + "</div>" * 60_000, "<p><b><i>" * 60_000, "<li>" * 60_000 + "x"])
def test_long_odd_pages_are_linear(html):
    began = time.process_time()
    assert html_text.main_text(html) is not None
    assert time.process_time() - began < 10


def test_html_frame(spark):
    got = html_text.extract(frame(spark, [(1, None), (1, "<p>a"), (2, "<p>b" * 20_000)], "page_id long, html string")).collect()
    assert [len(r.main_text) for r in got] == [0, 1, 39_999]
    assert html_text.extract(frame(spark, [], "page_id long, html string")).count() == 0


# ---- mixing


def test_mixing(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    got = mixing.mixed(docs, labels).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    assert np.allclose(got.p_good + got.p_poor + got.p_toxic, 1)
    totals = np.array([(got.rate * got.n_tokens * got[f"p_{d}"]).sum() for d in mixing.DOMAINS])
    assert np.abs(totals / totals.sum() - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.01
    words = {i: len(WORD.findall(t)) for i, t in texts(spark).items()}
    assert all(words[r.doc_id] == r.n_tokens for r in got.itertuples())
    plan = mixing.posteriors(docs, mixing.train(docs, labels))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    nobody = frame(spark, [], "doc_id long, quality int, toxic int")
    odd = mixing.mixed(frame(spark, ODD), nobody).collect()
    assert len(odd) == len(ODD) and all(abs(r.p_good - 1 / 3) < 1e-9 for r in odd)
    assert mixing.mixed(frame(spark, []), labels).count() == 0
    assert mixing.thinned(docs.withColumn("drawn", F.lit(1)), labels).columns == [*docs.columns, "drawn"]


def test_mixing_is_the_least_squares_optimum(spark):
    """The fitted rates against non-negative least squares by brute force: many plain projected gradient steps over all documents."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    for targets in (mixing.TARGETS, {"good": 0.7, "poor": 0.1, "toxic": 0.2}):
        got = mixing.mixed(docs, labels, targets).toPandas()
        p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
        a = (p * got.n_tokens.to_numpy()[:, None]).T
        now = a.sum(1)
        aims = mixing.SLACK * now[0] / targets["good"] * np.array([targets[d] for d in mixing.DOMAINS])
        loss = lambda r: float((((a @ r) - aims) ** 2).sum()) / float((aims**2).sum())
        r = np.ones(len(got))
        step = 1 / np.linalg.norm(a @ p, 2)
        for _ in range(4_000):
            r = np.maximum(0, r - step * (p @ (a @ r - aims)))
        assert (got.rate >= 0).all() and loss(got.rate.to_numpy()) <= loss(r) + 1e-4


def test_mixing_recall_held_out(spark):
    """On sf0.1, over rows not learned from: how many toxic documents are called toxic, and good ones good."""
    at = SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    unseen = _stats.held_out(F.col("doc_id"))
    got = mixing.posteriors(docs.join(labels.where(unseen), "doc_id"), mixing.train(docs, labels.where(~unseen))).drop("text").toPandas()
    said = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy().argmax(1)
    good, toxic = (got.quality == 1) & (got.toxic == 0), got.toxic == 1
    assert (said[toxic] == 2).mean() > 0.6 and (said[good] == 0).mean() > 0.97


def test_mixing_repeats_what_is_scarce(spark):
    rng = random.Random(5)
    said = {"good": "alpha beta gamma delta", "poor": "click buy now cheap", "toxic": "hate vile awful scum"}
    kinds = ["good"] * 900 + ["poor"] * 4 + ["toxic"] * 9
    rows = [(i, " ".join(rng.choices(said[k].split(), k=60))) for i, k in enumerate(kinds)]
    labels = frame(spark, [(i, int(k != "poor"), int(k == "toxic")) for i, k in enumerate(kinds)], "doc_id long, quality int, toxic int")
    out = [r.doc_id for r in mixing.thinned(frame(spark, rows), labels).collect()]
    many = collections.Counter(kinds[i] for i in out)
    assert set(out) == set(range(len(rows)))
    for k, target in mixing.TARGETS.items():
        assert abs(many[k] / len(out) - target) < 0.006, many
    got = mixing.mixed(frame(spark, rows), labels).collect()
    assert sum(r.copies for r in got) == len(out) and all(r.drawn and abs(r.copies - r.rate) < 1 for r in got)


def test_mixing_says_what_it_missed(spark):
    with pytest.warns(UserWarning, match="target tokens"):
        mixing.mixed(frame(spark, [(1, "a b"), (2, "c d")]), frame(spark, [], "doc_id long, quality int, toxic int"))


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}  # noqa: SIM115
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(tokenizer):
    path, pattern, enc = tokenizer
    codec = bpe.Codec(bpe.read_ranks(path), pattern)
    rng = random.Random(1)
    tokens = codec.tokens
    cases = ["", "a" * 3000, "\n" * 500, "<|endoftext|>", "🙂🙃" * 50]
    cases += ["".join(rng.choice("abcdehinorstuz éàü日本語한국🙂́\n\t01#$") for _ in range(rng.randint(1, 60))) for _ in range(2500)]
    cases += ["".join(rng.choice(tokens[256:]).decode("utf8", "ignore") for _ in range(10)).replace(" ", "") for _ in range(1500)]
    for text in cases:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text), text[:80]
        assert codec.decode(ids).decode() == text


def test_bpe_frame(spark, tokenizer):
    path, pattern, enc = tokenizer
    rows = list(ODD) + list(texts(spark).items())
    both = bpe.decode(bpe.encode(frame(spark, rows), path, pattern), path, pattern).collect()
    once = bpe.round_trip(frame(spark, rows), path, pattern).collect()
    for got in (both, once):
        assert all(np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "") for r in got)
    assert bpe.round_trip(frame(spark, []), path, pattern).count() == 0
    with pytest.raises(ValueError, match="ids"):
        bpe.encode(frame(spark, [(1, "a", 1)], "doc_id long, text string, ids int"), path, pattern)


# ---- quality rules and trees


def brute_counts(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_rules(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = list(ODD) + list(texts(spark).items())
    got = quality_rules.judge(frame(spark, rows), quality_rules.train(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *rest = brute_counts(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n) and not (r.base_failed and r.kept) and 0 <= r.chance <= 1
    none = quality_rules.train(docs, frame(spark, [], "doc_id long, quality int, toxic int"))
    assert quality_rules.judge(frame(spark, [(1, "a b")]), none).first().chance == 0.5


def test_chance_against_plain_features(spark):
    """The calibrated chance from the model's weights, n-gram by n-gram in plain Python, and the verdict that follows."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality_rules.train(docs, labels)
    rows = list(ODD)[:-2] + [(50, "é€😀 ü日本 a"), (51, "ab"), (52, "日")] + list(texts(spark).items())[:30]

    def tri(a, b, c):
        m = (1 << 32) - 1
        t = (ord(a) * 2654435761 & m) ^ (ord(b) * 2246822519 + 374761393 & m) ^ (ord(c) * 3266489917 + 668265263 & m)
        return ((t ^ (t >> 15)) * 2654435761 & m) >> 21

    for r in quality_rules.judge(frame(spark, rows), model).collect():
        text = r.text or ""
        data = np.frombuffer(text.encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), 0, 1)
        h = w.hashes()
        words = [int(x) >> 53 for x in [*h, *w.windows(2, h)[0]]]
        chars = [tri(*text[i : i + 3]) for i in range(len(text) - 2)]
        mean = lambda table, at: sum(table[k] for k in at) / max(1, len(at))
        z = mean(model.word, words) + mean(model.char, chars) + model.bias
        chance = 1 / (1 + np.exp(-(model.slope * z + model.shift)))
        assert abs(chance - r.chance) < 1e-9 and r.kept == (not r.base_failed and r.chance >= quality_rules.KEEP)


def test_learning_takes_one_row_an_id(spark):
    rows = [(i % 3, f"text number {i}") for i in range(300)] + [(9, "nine"), (None, "none")]
    labels = frame(spark, [(0, 1, 0), (0, 0, 0), (1, 1, 0), (1, None, 1), (2, 0, 0), (9, 1, 0), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = _stats.labelled(frame(spark, rows), labels, "quality", 100).collect()
    want = {i: (y, t) for i, y, t in [(0, 0, "text number 0"), (1, 1, "text number 1"), (2, 0, "text number 101"), (9, 1, "nine")] if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(got) == len(want) and {r.doc_id: (r.y, r.text) for r in got} == want


def test_trees_against_a_plain_walk(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    forest = quality_gbt.train(docs, labels)
    rows = list(ODD) + list(texts(spark).items())[:60]
    for r in quality_gbt.score(frame(spark, rows), forest).collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        x = _stats.statistics(Words(data, np.array([0, len(data)]), 0, 1))[0]
        total = forest.start
        for feature, cut, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12


def test_short_rows_are_linear():
    import pyarrow as pa

    data, at = buffers(pa.array(["ab cd"] * 60_000))
    began = time.process_time()
    w = Words(data, at, 0, 60_000)
    one = quality_rules._row_shares(*quality_rules._columns(w, w.hashes())[:2])
    assert time.process_time() - began < 5 and len(one[0]) >= 60_000


def test_empty_and_clashing_columns(spark):
    """Extra columns pass through or are ignored; names that an operator adds are refused; empty tables give no rows."""
    nobody = frame(spark, [], "doc_id long, quality int, toxic int")
    wide = frame(spark, [(1, "a b c", 7, 8, "x")], "doc_id long, text string, token int, y int, lang string")
    assert syncmer.edited_fingerprints(wide.withColumn("guard", F.lit(1))).count() == 1
    assert suffix_dedup.trim(wide.withColumn("cuts", F.lit(1))).count() == 1
    assert quality_gbt.classified(wide.withColumn("stats", F.lit(1)), nobody).count() == 1
    assert quality_rules.judged(wide.withColumn("fold", F.lit(1)), nobody).count() == 1
    for call, name in ((lambda d: secrets.scan(d), "spans"), (lambda d: quality_gbt.score(d, quality_gbt.train(d, nobody)), "score"), (lambda d: quality_rules.judge(d, quality_rules.train(d, nobody)), "kept"), (lambda d: html_text.extract(d, "text"), "main_text")):
        with pytest.raises(ValueError, match=name):
            call(wide.withColumn(name, F.lit(1)))
    for call in (lambda d: secrets.scan(d), lambda d: quality_gbt.score(d, quality_gbt.train(d, nobody)), lambda d: quality_rules.judge(d, quality_rules.train(d, nobody)), lambda d: html_text.extract(d, "text")):
        got = call(wide).first()
        assert (got.token, got.y, got.lang) == (7, 8, "x")
        assert call(wide.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    """On sf0.01, over rows neither learned from."""
    at = SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    trees = quality_gbt.classified(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (trees.predicted == trees.quality).mean() > 0.95
    assert (trees[trees.quality == 1].predicted == 1).mean() > 0.97
    rules = quality_rules.judged(docs, labels).join(labels, "doc_id").where("NOT base_failed").toPandas().merge(trees[["doc_id"]], on="doc_id")
    assert rules[rules.quality == 1].kept.mean() > 0.95


def test_trees_odd(spark):
    nobody = frame(spark, [], "doc_id long, quality int, toxic int")
    got = quality_gbt.classified(frame(spark, ODD), nobody).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == 0 for r in got)
    rng = np.random.RandomState(0)
    x = rng.rand(500, 20).astype(np.float32)
    forest = quality_gbt.grow(x, (x[:, 3] > 0.5).astype(float))
    assert ((forest.score(x) > 0.5) == (x[:, 3] > 0.5)).mean() > 0.98


def test_words_are_cut_like_python(spark):
    import pyarrow as pa

    rng = random.Random(0)
    rows = ["".join(rng.choices("aB é\n\t \x0b\x0c\r\x1c", k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "x"]
    data, at = buffers(pa.array(rows))
    got = [w.data[a:b].tobytes().decode() for lo, hi in slices(at) for w in [Words(data, at, lo, hi)] for a, b in zip(w.starts, w.ends, strict=True)]
    assert got == [x for r in rows for x in WORD.findall(r or "")]
