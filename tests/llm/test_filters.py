import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pixsieve.llm import decontaminate, nearcopies, quality, toxicity
from pixsieve.llm.html import main_text
from pixsieve.llm.words import word_hashes


def test_words_are_numbered_by_their_bytes():
    texts = ["A b  a", "", "ab é", " b", "Ü ü"]
    words, counts, first, last = word_hashes(pa.array(texts))
    assert counts.tolist() == [3, 0, 2, 1, 2]
    assert words[0] == words[2] and words[1] == words[5] and len(set(words.tolist())) == 6
    stripped, counts, _, _ = word_hashes(pa.array(["a, b!", "... a b"]), strip=True)
    assert counts.tolist() == [2, 2] and (stripped[:2] == stripped[2:]).all()


def test_deobfuscation(spark):
    text = "the idiot and the loser are stupid trash in the scum of the moron that worthless clown said to be a disgusting thing " * 30
    docs = spark.createDataFrame([(text,)], "text STRING")
    model = toxicity.char_model(toxicity.char_counts(docs, "text"))
    assert abs(np.exp(model.reshape(-1, 32)).sum(axis=1) - 1).max() < 1e-3
    for seen, meant in {"!diot": "idiot", "(lown": "clown", "iiddiioott": "idiot", "ccllowwnn": "ccllowwnn", "1d10t": "idiot", "l.o.s.e.r": "loser", "i d i o t": "idiot", "stuuuupid": "stupid", "tr@sh": "trash", "the": "the"}.items():
        assert toxicity.decode(seen, model) == meant


def test_which_words_are_read_through_the_lattice():
    seen = "!diot (lown iiddiioott 1d10t aabbcc (sd) plain end! (see also) aabb wheel balloon x"
    body = np.frombuffer(seen.encode(), np.uint8)
    inside = body != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    first, last = edges[::2], edges[1::2]
    odd, _ = toxicity.suspicious(body, first, last, np.zeros(len(first), np.int64))
    assert [w for w, o in zip(seen.split(), odd, strict=True) if o] == ["!diot", "(lown", "iiddiioott", "1d10t", "aabbcc", "(see"]


def test_toxicity_finds_hidden_words(spark, odd_docs, no_docs):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("aeiounrstl"), 5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        body = list(rng.choice(words, 40))
        if toxic:
            body[int(rng.integers(40))] = ["blorgh", "b l o r g h", "bl0rgh", "blooooorgh", "b.l.o.r.g.h"][i % 5] if i > 500 else "blorgh"
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    known = spark.createDataFrame(labels + [(None, 1), (5000, None), (3, None)], "doc_id LONG, toxic INT")
    got = {r.doc_id: r for r in toxicity.scored(docs, known).collect()}
    wrong = sum(got[i].predicted != y for i, y in labels)
    assert wrong <= 20 and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i, y in labels if got[i].held_out]
    assert held and sum(got[i].predicted != labels[i][1] for i in held) <= 6
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns and abs(kept.count() - 600) <= 20
    odd = toxicity.scored(odd_docs, known).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.scored(no_docs, known).count() == 0
    assert {r.score for r in toxicity.scored(docs, known.where("false")).collect()} == {0.5}


def alike(a, b):
    def shingled(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []

    x, y = shingled(a), shingled(b)
    if not x or not y:
        return False
    table = np.zeros((len(x) + 1, len(y) + 1), int)
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            table[i + 1, j + 1] = table[i, j] + 1 if p == q else max(table[i, j + 1], table[i + 1, j])
    m = int(table[-1, -1])
    return m / (len(x) + len(y) - m) >= 0.8 - 1e-12


def test_near_classes_equal_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    passage = list(rng.choice(words, 40))
    texts = []
    for _ in range(12):
        base = list(rng.choice(words, int(rng.integers(6, 150))))
        for k in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, 1 + len(own) // 30))):
                own[int(rng.integers(len(own)))] = str(rng.choice(words))
            texts.append(" ".join(own if k % 3 else own + own[:2]))
    texts += [" ".join([*passage, *rng.choice(words, int(rng.integers(1, 60)))]) for _ in range(40)]  # a passage many share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    got = {r.doc_id: r for r in nearcopies.near_classes(docs).collect()}
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or alike(texts[i], texts[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {i: root(i) for i in range(len(texts))} == {i: r.class_id for i, r in got.items()}
    sizes = Counter(root(i) for i in range(len(texts)))
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert nearcopies.one_each(docs).count() == len(sizes)

    odd = nearcopies.near_classes(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    by_id = defaultdict(list)
    for r in odd:
        by_id[r.doc_id].append(r)
    assert [r.class_id for r in by_id[8]] == [7] and by_id[7][0].class_size == 4 and sum(r.kept for r in by_id[7]) == 1
    assert {r.class_id for r in by_id[None]} == {7, 1} and by_id[5][0].class_id == 4 and by_id[6][0].class_id == 4
    assert nearcopies.near_classes(no_docs).count() == 0
    assert nearcopies.one_each(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("band", [None, 3, 50])
def test_alignment_in_a_band(band):
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, int(rng.integers(0, 40))), rng.integers(0, 6, int(rng.integers(0, 40)))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (x == y))
        m = nearcopies.aligned(a.astype(np.uint64), b.astype(np.uint64), band)
        assert m <= table[-1, -1]
        if band is None or max(len(a), len(b)) - table[-1, -1] <= band:
            assert m == table[-1, -1]


def test_tiling_is_greedy_and_whole():
    p, t = np.arange(1, 21, dtype=np.uint64), np.array([11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 0, 1, 2, 3, 4, 5, 6, 99, 7, 8, 9, 10], np.uint64)
    assert sorted(decontaminate.tiles(p, t, 5)) == [(0, 11, 6), (10, 0, 10)]
    assert sum(n for _, _, n in decontaminate.tiles(p, t, 4)) == 20
    assert decontaminate.tiles(p, np.array([1, 2, 3, 0, 4, 5, 6], np.uint64), 4) == []


def plain_tiling(pattern, text, least):
    """Marks the longest common run of unmarked words, the first in the pattern, then in the text, until none is long enough."""
    used_p, used_t, out = [False] * len(pattern), [x == 0 for x in text], []
    while True:
        best = (0, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[2]:
                    best = (p, t, n)
        p, t, n = best
        if n < least:
            return out
        used_p[p : p + n], used_t[t : t + n] = [True] * n, [True] * n
        out.append(best)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 9])
def test_tiling_equals_plain_search(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        p, t = ([rng.randint(1, alphabet) for _ in range(rng.randint(0, 30))] for _ in range(2))
        t = [0 if rng.random() < 0.05 else x for x in t]
        least = rng.randint(1, 5)
        assert decontaminate.tiles(np.array(p, np.uint64), np.array(t, np.uint64), least) == plain_tiling(p, t, least)


def test_tiling_of_long_and_repetitive_texts_is_quick():
    word, rng = np.full(20_000, 7, np.uint64), np.random.default_rng(1)
    long = rng.integers(1, 2**63, 20_000).astype(np.uint64)
    shuffled = np.concatenate([x for x in np.array_split(long, 190)[::-1]])
    before = time.process_time()
    assert decontaminate.tiles(word, word, 5) == [(0, 0, 20_000)]
    assert decontaminate.tiles(word[:100], word, 5) == [(0, 0, 100)] and decontaminate.tiles(word, word[:100], 5) == [(0, 0, 100)]
    assert time.process_time() - before < 2
    before = time.process_time()
    assert decontaminate.tiles(long, np.concatenate([long[:50], long]), 5) == [(0, 50, 20_000)]
    assert time.process_time() - before < 2
    assert sum(n for _, _, n in decontaminate.tiles(long, shuffled, 5)) == 20_000


def test_decontamination(spark, odd_docs, no_docs):
    item = " ".join(f"w{k}" for k in range(40))
    halves = item.split()
    docs = spark.createDataFrame(
        [
            (1, f"before. {item.upper()}, after"), (2, " ".join(["x", *halves[25:], "y", *halves[:25]])), (3, " ".join(halves[:12])), (4, "nothing of it"),
            (5, None), (5, item), (6, "so short one is here"), (None, item),
        ],
        "doc_id LONG, text STRING",
    )
    items = spark.createDataFrame([(0, item), (1, "short one"), (2, None), (None, "nothing of it"), (3, ""), (4, item)], "item_id LONG, text STRING")
    got = Counter((r.doc_id, r.contaminated, tuple(r["items"])) for r in decontaminate.contaminated(docs, items).collect())
    assert got == Counter({(1, True, (0, 4)): 1, (2, True, (0, 4)): 1, (3, False, ()): 1, (4, True, ()): 1, (5, False, ()): 1, (5, True, (0, 4)): 1, (6, True, (1,)): 1, (None, True, (0, 4)): 1})
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [3, 5]
    assert decontaminate.clean(odd_docs, items).columns == odd_docs.columns
    assert decontaminate.contaminated(odd_docs, items).count() == odd_docs.count()
    assert decontaminate.contaminated(no_docs, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contaminated(docs, items.where("false")).collect())


def test_quality_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("the cat sat on the mat and the dog sat too",), ("a cat is a cat",), ("",)], "text STRING")
    logs = quality.log_table(quality.kneser_ney(quality.run_counts(docs)))
    sums = np.exp(logs.reshape(-1, 64).astype(float)).sum(axis=1)
    assert abs(sums - 1).max() < 1e-3


def brute_perplexity(trusted, texts):
    grams = lambda t: [tuple("\ue000" * 3 + t + "\ue000")[i : i + 4] for i in range(len(t) + 1)]
    level, orders = Counter(g for t in trusted for g in grams(t)), []
    for _ in range(4):
        n1, n2, n3, n4 = (sum(n == k for n in level.values()) for k in (1, 2, 3, 4))
        d = (0.5, 0.75, 0.75)
        if n1 and n2:
            y = n1 / (n1 + 2 * n2)
            d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
            d = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]
        total, held = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            held[g[:-1]] += d[min(n, 3) - 1]
        orders.insert(0, ({g: (n - d[min(n, 3) - 1]) / total[g[:-1]] for g, n in level.items()}, {c: held[c] / total[c] for c in total}))
        level = Counter(g[1:] for g in level)

    def log_p(g):
        p = 1 / quality.SYMBOLS
        for k, (parts, weights) in enumerate(orders, 1):
            p = parts.get(g[-k:], 0) + weights.get(g[-k:][:-1], 1) * p
        return np.log(p)

    return [float(np.exp(-np.mean([log_p(g) for g in grams(t)]))) for t in texts]


def test_quality_model_reads_every_script(spark):
    rng = np.random.default_rng(4)
    trusted = [" ".join(rng.choice(["слово", "текст", "дело", "文字列", "λόγος", "12", "19", "🙂"], 30)) for _ in range(20)]
    texts = [*trusted, "", "q", "дело текст", "".join(rng.permutation(list(trusted[0]))), "文列字 λόογς", "e\u0301 \x00"]
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts)], "doc_id LONG, text STRING, lang STRING").repartition(4)
    orders = quality.kneser_ney(quality.run_counts(spark.createDataFrame([(t,) for t in trusted], "text STRING")))
    got = {r.doc_id: (r.n_symbols, r.perplexity) for r in quality.perplexities(docs, orders, "doc_id", "text", "lang", 300).collect()}
    want = brute_perplexity(trusted, texts)
    assert [got[i][0] for i in range(len(texts))] == [len(t) + 1 for t in texts]
    assert [got[i][1] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)
    assert got[23][1] > 3 * max(want[:20])  # the same letters in no order


def test_quality_tells_junk(spark, odd_docs, no_docs):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("aeiounrstl"), 4)) for _ in range(80)]
    good = [(i, " ".join(rng.choice(words, 60)), "en") for i in range(150)]
    junk = [(1000 + i, "".join(rng.choice(list("#$%&QXZ0179"), 200)), "en") for i in range(20)]
    docs = spark.createDataFrame([*good, *junk, (2000, None, None), (2000, "", "xx")], "doc_id LONG, text STRING, lang STRING")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 150, 2)] + [(1, 0), (None, 1), (3, None)], "doc_id LONG, quality INT")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    assert sum(got[i].keep for i, _, _ in good) >= 115 and not any(got[i].keep for i, _, _ in junk)
    assert quality.judged(odd_docs, labels).count() == odd_docs.count()
    assert quality.judged(no_docs, labels).count() == 0
    assert all(r.keep for r in quality.judged(docs, labels.where("false")).collect())


STOPS = frozenset("the of and to in a is that".split())


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("no markup at all", ""), ("<article><p>a &amp; b</p></article>", "a & b"),
        ("<nav><a href=x>The home of the site</a></nav><article><h1>T</h1><p>x  y\n z<script>var a='<p>'</script></p><div class='comments'><p>the first of the comments is in</p></div></article><footer>f</footer>", "T\nx y z"),
        ("<article><p>cut <b>off &am", "cut off &am"), ("<!-- c --><article><p>a<br>b<li>c</article>", "a b\nc"),
        ("<div class='has-sidebar'><p>The man of the town is in the house of a friend and that is it.</p><p>Yes.</p></div><div id=sidebar><p>The man of the town is in the house of a friend.</p></div>", "The man of the town is in the house of a friend and that is it.\nYes."),
    ],
)
def test_main_text(page, text):
    assert main_text(page, STOPS) == text


PROSE = "The man of the town is in the house of a friend and that is it."
HAN = "这是第一段很长的文字，讲的是城里的一个人和他的朋友，以及他们住的房子，还有那里发生的许多事情。"
GERMAN = "Der Mann aus der Stadt wohnt heute im Haus eines Freundes am Ende der Gasse."


@pytest.mark.parametrize(
    "page, stops, text",
    [
        (f"<body><p>{HAN}</p><p>{HAN}</p><a href=x>首页</a></body>", STOPS, f"{HAN}\n{HAN}"),
        (f"<body><nav>Start Seite</nav><p>{GERMAN}</p></body>", frozenset(), GERMAN),
        (f"<body><p>{GERMAN}</p></body>", STOPS, ""),
        (f"<div class='legal-guide'><p>{PROSE}</p><p>Short.</p></div>", STOPS, f"{PROSE}\nShort."),
        (f"<article><p>{PROSE}</p><div class='share-price'><p>It rose by a third.</p></div></article>", STOPS, f"{PROSE}\nIt rose by a third."),
        (f"<div class='cookie-box'><p>{PROSE}</p></div><div id='comment_12'><p>{PROSE}</p></div><p>{PROSE}</p>", STOPS, PROSE),
        (f"<div class='article'><p>{PROSE}</p></div><div class='related-posts'><p>{PROSE}</p></div>", STOPS, PROSE),
    ],
)
def test_main_text_without_stop_words_and_with_hints(page, stops, text):
    assert main_text(page, stops) == text


def test_very_long_and_deep_pages():
    many = "".join(f"<p>{PROSE} {k}</p>" for k in range(20_000))
    assert len(main_text(f"<article>{many}</article>", STOPS).split("\n")) == 20_000
    assert main_text("<div>" * 50_000 + f"<p>{PROSE}" + "</div>" * 50_000, STOPS) == PROSE
    assert main_text(f"<article><p>{'x' * 2_000_000}", STOPS) == "x" * 2_000_000


def test_stop_words_are_exact_however_pages_are_dealt(spark):
    from pixsieve.llm import html

    body = " ".join(["alpha beta"] * 30 + [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(400)])
    rows = [(i, None, " " * 5000 + f"<!-- x --><html lang={lang}><p>{body}</p>") for i, lang in enumerate(["en-GB"] * 30 + ["klingon", "tlh", "DE"])]
    rows.append((99, None, "<html lang=xx><p>once each here</p>"))
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    want = {lang: frozenset({"alpha", "beta"}) for lang in ("en", "", "tlh", "de")}
    assert html.stop_words(pages.repartition(7)) == html.stop_words(pages.coalesce(1), held_words=50) == want


def test_pages_table(spark):
    from pixsieve.llm import html

    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<article><p>the end", "x"), (2, "u", "", "x"), (2, "u", "", "x")], "page_id LONG, url STRING, html STRING, text STRING")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(pages).collect())
    assert got == Counter({(1, None, "", 0): 1, (None, "u", "the end", 7): 1, (2, "u", "", 0): 2})
    assert html.extract(pages.where("false")).count() == 0
