"""Packing, language-model scores, toxicity and page extraction."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from mergeloom.llm import html, packing, ppm, queries, toxicity

DOC = "doc_id long, text string, length int, part int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOC)


def sequential_best_fit(lengths, window):
    """Piece by piece: each into the tightest open window."""
    open_, used = [], 0
    for n in sorted(lengths, reverse=True):
        fits = [k for k, c in enumerate(open_) if c >= n]
        if fits:
            k = min(fits, key=lambda k: open_[k])
            open_[k] -= n
        else:
            open_.append(window - n)
            used += 1
    return sorted(open_)


def test_best_fit_is_that_of_pieces():
    r = random.Random(1)
    for _ in range(200):
        window = r.choice([8, 16, 31, 64])
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 60))]
        placed = packing.best_fit(dict(Counter(lengths)), window)
        fill, ends = Counter(), Counter(lengths)
        for k, (length, rank, first, per, offset) in enumerate(placed):
            nxt = placed[k + 1] if k + 1 < len(placed) and placed[k + 1][0] == length else None
            for i in range((nxt[1] if nxt else ends[length]) - rank):
                w = first + i // per
                assert fill[w] == offset + i % per * length
                fill[w] += length
        assert sum(fill.values()) == sum(lengths) and all(v <= window for v in fill.values())
        assert sorted(window - v for v in fill.values()) == sequential_best_fit(lengths, window)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tk = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [" ".join(r.choice(["Hello", "WORLD's", "naïve", "x<|endoftext|>y", "12a", "Ⅷ", "é q", "ΟΔΟΣ"]) for _ in range(r.randint(0, 300))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "long word " * 9000), (None, "null id"), (5, texts[5]), (5, "other")]
    out = packing.packed(rows_of(spark, rows), path).collect()
    ids = lambda t: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    want = Counter()
    for i, t in rows:
        a = ids(t)
        want.update((i, s, min(4096, len(a) - s), zlib.crc32(a[s : s + 4096].tobytes()), len(a)) for s in range(0, len(a), 4096))
    assert Counter((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in out) == want
    by = {}
    for x in out:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(x.length for x in out)
    assert len(by) <= math.ceil(total / 4096) + 1
    assert packing.packed(rows_of(spark, []), path).count() == 0


def brute_ppm(counts, context, byte):
    """Probability by walking down the contexts with method C and exclusion."""
    excluded, p = set(), 1.0
    for k in range(ppm.DEPTH - 1, -1, -1):
        c = counts[k].get(context[len(context) - k :] if k else b"")
        if not c:
            continue
        left = {s: n for s, n in c.items() if s not in excluded}
        if not left:
            continue
        total, kinds = sum(left.values()), len(left)
        # a context that knew more bytes before exclusion still escapes by those left
        if byte in left:
            return p * left[byte] / (total + kinds)
        p *= kinds / (total + kinds)
        excluded |= set(c)
    return p / (ppm.SYMBOLS - len(counts[0].get(b"", ())))


def test_trie_against_walk():
    r = random.Random(3)
    train = ["".join(r.choice("abca ") for _ in range(r.randint(0, 40))).encode() for _ in range(20)]
    test = ["".join(r.choice("abcd é") for _ in range(r.randint(0, 30))).encode() for _ in range(10)]
    counts = [{} for _ in range(ppm.DEPTH)]
    for t in train:
        full = ppm.START * (ppm.DEPTH - 1) + t + ppm.STOP
        for at in range(ppm.DEPTH - 1, len(full)):
            for k in range(ppm.DEPTH):
                counts[k].setdefault(full[at - k : at], Counter())[full[at]] += 1
    g = ppm.grams(train)[0]
    levels = [np.unique(g & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True) for k in range(ppm.DEPTH)]
    trie = ppm.Trie.build(levels)
    for t, s in zip(test, trie.scores(test), strict=True):
        full = ppm.START * (ppm.DEPTH - 1) + t + ppm.STOP
        want = sum(math.log10(brute_ppm(counts, full[at - ppm.DEPTH + 1 : at], full[at])) for at in range(ppm.DEPTH - 1, len(full)))
        assert s == pytest.approx(want, rel=1e-9)
    assert ppm.Trie.build([(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * ppm.DEPTH).scores([b"ab"])[0] == pytest.approx(-3 * math.log10(257))


def test_scores(spark):
    r = random.Random(4)
    words = ["the", "Cat", "sat", "on", "é", "mat", "x\x1cy"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(90, None), (91, ""), (None, "the null"), (7, "the the"), (92, "w" * 20_000)]
    out = ppm.scored(rows_of(spark, rows)).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update([*(t or "").encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        ts = [*(t or "").encode().lower().split(), None]
        want.append((str(i), held(i), len(ts), sum(c[x] > 0 for x in ts), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts), 6)))
    assert sorted((str(x.doc_id), x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out) == sorted(want)
    assert all(x.score < 0 for x in out)
    assert ppm.scored(rows_of(spark, [])).count() == 0


def test_all_grams_count_at_every_size(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choices("abcdefghij é", k=30_000))) for i in range(110)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [t.encode() for i, t in rows if not held(i)]
    assert sum(map(len, train)) > 1 << 21
    trie = ppm.Trie.build(ppm.levels(*np.unique(np.concatenate([ppm.grams([t])[0] for t in train]), return_counts=True), range(ppm.DEPTH)))
    want = dict(zip([i for i, _ in rows], trie.scores([t.encode() for _, t in rows]), strict=True))
    for x in ppm.scored(rows_of(spark, rows)).collect():
        assert x.score == pytest.approx(want[x.doc_id], rel=1e-9)


def kernel_by_hand(a, b, n, decay):
    """Sum over common subsequences of n letters of decay to the letters that they span."""
    from itertools import combinations

    out = 0.0
    for i in combinations(range(len(a)), n):
        for j in combinations(range(len(b)), n):
            if all(a[x] == b[y] for x, y in zip(i, j, strict=True)):
                out += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return out


def test_subsequence_kernel():
    r = random.Random(5)
    words = [bytes(r.choice((1, 2, 3)) for _ in range(r.randint(0, 7))) for _ in range(30)]
    got = toxicity.kernel(words, words[::-1])
    for a, b, k in zip(words, words[::-1], got, strict=True):
        assert k == pytest.approx(kernel_by_hand(a, b, toxicity.ORDER, toxicity.DECAY))


def labelled(n, seed):
    r = random.Random(seed)
    syllables = "th er on an re in ou ble ly at ion es sh nt or ha ed".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    texts, toxic = [], []
    for _ in range(n):
        y = int(r.random() < 0.3)
        sentences = [[word() for _ in range(r.randint(4, 14))] for _ in range(r.randint(1, 8))]
        for _ in range(2 * y):
            s = r.choice(sentences)
            s.insert(r.randrange(len(s)), r.choice(["blargh", "zwockel", "dumfk"]))
        texts.append(". ".join(" ".join(s).capitalize() for s in sentences) + ".")
        toxic.append(y)
    return texts, toxic


def test_toxicity_held_out(spark):
    texts, toxic = labelled(500, 6)
    docs = rows_of(spark, list(enumerate(texts)))
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new, truth = labelled(200, 7)
    out = {x.doc_id: x.score for x in toxicity.scored(rows_of(spark, list(enumerate(new))), model).collect()}
    right = sum((out[i] >= 0.3) == bool(y) for i, y in enumerate(truth))
    assert right >= 194
    odd = ["Er zw.oc.kel th.", "the zwockkel er.", "here z w o c k e l again, b l a r g h.", None, "", "�🙂" * 3, "th" * 30_000, "er the on."]
    got = {x.doc_id: x.score for x in toxicity.scored(rows_of(spark, list(enumerate(odd))), model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[0] > got[7] and got[1] > got[7] and got[2] >= 0.3
    assert got[3] == got[4] < 0.3
    assert toxicity.scored(rows_of(spark, []), model).count() == 0
    kept = toxicity.kept(rows_of(spark, list(enumerate(new))), model, 0.3)
    assert {x.doc_id for x in kept.collect()} == {i for i, s in out.items() if s < 0.3} and kept.columns == ["doc_id", "text", "length", "part"]
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(x.score, 6) for x in toxicity.scored(docs.limit(3), none).collect()} == {1e-6}


def plain_kernel(a, b):
    """The gap-weighted kernel by its definition over all pairs of places, one letter of the subsequence at a time."""
    d = toxicity.DECAY
    ends = {(i, j): d * d for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]}
    for _ in range(toxicity.ORDER - 1):
        ends = {(i, j): sum(v * d ** (i - x + j - y) for (x, y), v in ends.items() if x < i and y < j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]}
    return sum(ends.values())


def plain_score(text, model):
    """A document's probability from the model's numbers, word by word."""
    marks = [(m, toxicity._pairs([m], 1)[0]) for m in model.landmarks]

    def vector(codes):
        word = toxicity.bounded(codes)
        out = np.zeros(len(marks))
        step = toxicity.LONGEST // 2
        for a in range(0, max(1, len(word) - step), step):
            part = word[a : a + toxicity.LONGEST]
            near = toxicity._pairs([part], toxicity.REACH)[0]
            for k, (m, own) in enumerate(marks):
                if np.bitwise_count(near & own).sum() >= math.ceil(toxicity.SHARED * np.bitwise_count(own).sum()):
                    v = plain_kernel(part, m) / math.sqrt(plain_kernel(part, part) * plain_kernel(m, m)) if plain_kernel(part, part) else 0.0
                    out[k] = max(out[k], v if v >= toxicity.LEAST else 0.0)
        return out

    sentences, run = [np.zeros(len(marks))], []

    def spelled():
        if len(run) > 2:
            where, letters = run[0][0], b"".join(x for _, x in run)
            sentences[where] = np.maximum(sentences[where], vector(letters))
        run.clear()

    for w in (text or "").encode().split():
        codes = toxicity.letters(w)
        if len(codes) != 1:
            spelled()
        else:
            run.append((len(sentences) - 1, codes))
        sentences[-1] = np.maximum(sentences[-1], vector(codes))
        if w.rstrip(b"\"')*]%&$#|")[-1:] in (b".", b"!", b"?"):
            sentences.append(np.zeros(len(marks)))
    spelled()
    margins = sorted([model.bias, model.bias, *(s @ model.alpha + model.bias for s in sentences if s.any())])
    return 1 / (1 + math.exp(-np.array([margins[-1], margins[-2], 1.0]) @ model.curve))


def test_toxicity_query_against_a_plain_scorer(spark, tmp_path):
    texts, toxic = labelled(260, 16)
    texts[:4] = [None, "", "the b l a r g h er on. zw.o.ckel!", "Dumfkk ly " + "thon" * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op8_toxicity(spark, str(tmp_path)).collect()
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(260)}
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet").where("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 <> 2") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert {x.doc_id: x.held_out for x in out} == held and model.landmarks
    for x in out:
        if x.doc_id < 60:
            assert x.score == pytest.approx(plain_score(texts[x.doc_id], model), abs=1e-5), x.doc_id
        assert x.predicted == int(x.score >= 0.3)
    small = toxicity.fit(docs, labels, max_docs=20, max_bytes=3000)
    assert isinstance(small, toxicity.Model)


def test_pages(spark):
    model = html.train(250)
    new = html.training_pages(80, 11)
    got = html.extract([p for p, _ in new], model)
    assert sum(a == b for a, (_, b) in zip(got, new, strict=True)) >= 70
    page = '<html><body><nav><a href=x>menu one</a></nav><article class=post><h1>A &amp; B</h1><p>One  two<br>three.\n<p>Four <b>five</b>&nbsp;six, seven and eight.</article><div class="ad">Buy now.</div><footer>&copy; us</footer>'
    assert html.extract([page], model) == ["A & B One two three. Four five six, seven and eight."]
    odd = [None, "", "<", "<p", "</p></p>", "<script>x", "a<!-- b", "<p>" * 3000, "&#99999999; &bad; text", '<a href="x']
    rows = [(i, "u", t, "t") for i, t in enumerate(odd)] + [(None, None, page, "t"), (0, "u", page, "t")]
    out = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    assert len(out) == len(rows) and all(x.n_chars == len(x.text) for x in out)
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


#: Pages by hand: source, and the main text.
BY_HAND = {
    "news": ("""<html><head><title>T - Site</title><link rel=x></head><body><div id="top"><a href="/">Home</a> | <a href="/w">World</a></div>
<div class="story"><h1>River rises after a week of rain</h1><p class="byline"><a href="/a">A. Writer</a></p><p>The river rose by two metres overnight, officials said, and several roads were closed. Schools stay shut until Monday.</p>
<p>&ldquo;We have not seen this in years,&rdquo; said the mayor &amp; her deputy, who visited the bridge in the morning.</p><ul><li>Two roads are closed, the ring road and the mill lane.</li><li>Trains run, but they are late.</li></ul></div>
<aside class="related"><h4>Related</h4><a href="/1">Old flood</a><a href="/2">New dam</a></aside><div id="comments"><div class="comment"><p>I saw it too, it was awful.</p></div></div><div class="footer">&copy; 2020 The Site. <a href="/p">Privacy</a></div></body></html>""",
             "River rises after a week of rain The river rose by two metres overnight, officials said, and several roads were closed. Schools stay shut until Monday. “We have not seen this in years,” said the mayor & her deputy, who visited the bridge in the morning. Two roads are closed, the ring road and the mill lane. Trains run, but they are late."),
    "blog": ("""<!doctype html><body><header class="masthead"><p>My blog</p></header><main><article><h2>Bread without kneading</h2><p>Mix flour, water, salt and a little yeast in the evening, then leave the bowl alone.<p>In the morning, fold the dough twice, wait an hour and bake it hot.<blockquote>Patience does the work, my aunt used to say.</blockquote></article></main>
<section class="newsletter"><form><label>Mail</label><input><button>Join</button></form></section><footer>Powered by something.</footer>""",
             "Bread without kneading Mix flour, water, salt and a little yeast in the evening, then leave the bowl alone. In the morning, fold the dough twice, wait an hour and bake it hot. Patience does the work, my aunt used to say."),
    "broken": ("""<body><nav><ul><li><a href=a>One<li><a href=b>Two</ul></nav><div class="content"><p title="x>The first paragraph has a stray quote in its tag, which is no text.</p><button>go<p>The second one comes after a button that was never closed, and stays.</p><svg width=3><p>The third one comes after a drawing without an end.</p></div><div class=cookie-notice><p>We use cookies.</p></div>""",
               "The first paragraph has a stray quote in its tag, which is no text. The second one comes after a button that was never closed, and stays. The third one comes after a drawing without an end."),
    "wiki": ("""<div class="mw-head"><a href=1>Page</a><a href=2>Talk</a></div><div id="content"><h1>Otter</h1><p>The otter is a mammal that lives by rivers, lakes and the sea. It eats fish, crabs and frogs.</p><h2>Habitat</h2><p>Otters need clean water, and banks with cover. They rest in holts, which they dig or take over.</p><table><tr><td>Length</td><td>up to a metre, without the tail</td></tr></table></div><div class="sidebar"><ul><li><a href=3>Main page</a></li><li><a href=4>Contents</a></li></ul></div><script>var s = "<p>no text</p>";</script><div id="footer"><p>Last edited in May.</p></div>""",
             "Otter The otter is a mammal that lives by rivers, lakes and the sea. It eats fish, crabs and frogs. Habitat Otters need clean water, and banks with cover. They rest in holts, which they dig or take over. Length up to a metre, without the tail"),
    "ads": ("""<body><div class="ad-banner"><p>Buy two shoes, get one free. Only today, in all our shops.</p></div><div class="post"><h1>How to mend a sock</h1><p>Take a darning egg, a blunt needle and wool of the same weight, and start beside the hole.</p><div class="advertisement"><p>Great needles at low prices.</p></div><p>Weave over and under until the hole is gone, but don't pull the wool tight.</p></div><div class="social share"><a href=f>Share</a><a href=t>Send</a></div></body>""",
            "How to mend a sock Take a darning egg, a blunt needle and wool of the same weight, and start beside the hole. Weave over and under until the hole is gone, but don't pull the wool tight."),
    "plain": ("<p>Just one paragraph of text, without anything around it, as some pages are.</p>", "Just one paragraph of text, without anything around it, as some pages are."),
}


@pytest.fixture(scope="module")
def page_model():
    return html.train()


def test_pages_by_hand(page_model):
    for name, (source, truth) in BY_HAND.items():
        got = html.extract([source], page_model)[0]
        a, b = Counter(got.split()), Counter(truth.split())
        right = sum((a & b).values())
        assert right / b.total() >= 0.95 and right / max(1, a.total()) >= 0.9, (name, got)
        assert not set("<>") & set(got), (name, got)


def test_no_markup_comes_out(page_model):
    r = random.Random(12)
    bits = ["<p>", "</p>", "<div class=a>", "</div>", '<a href="', "'", '"', ">", "<svg", "</button", "<!--", "-->", "</", "</ x>", "<!x", "<?y", "<button>", "<object>", "text ", "more. ", "<br/>", "<style>", "</style>"]
    for _ in range(300):
        page = html.Page("".join(r.choice(bits) for _ in range(r.randint(1, 12))))
        assert not any(re.search("<[a-zA-Z/!?]", t) for t in page.text)


def every_labelling(page, margin):
    """The greatest log-likelihood over all labellings without a kept node below a dropped one."""
    keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    n, best = len(page.tag), -np.inf
    for mask in range(1 << (n - 1)):
        kept = [True, *(bool(mask >> i & 1) for i in range(n - 1))]
        if all(not kept[i] or kept[page.parent[i]] for i in range(1, n)):
            best = max(best, sum(keep[i] if kept[i] else drop[i] for i in range(1, n)))
    return best


def test_decoding_is_the_best_labelling():
    r = np.random.default_rng(9)
    sources = ["<div><p>a</p><ul><li>b<li>c</ul></div><p>d", "<main><p>a<p>b<div>c<p>d</div></main>", "x<div><div><div>y</div></div></div>z"]
    for source in sources:
        page = html.Page(source)
        assert len(page.tag) <= 13
        for _ in range(25):
            margin = r.normal(size=len(page.tag)) * 2
            kept = html.decode(page, margin)
            keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
            assert sum(keep[i] if kept[i] else drop[i] for i in range(1, len(kept))) == pytest.approx(every_labelling(page, margin))


def test_decoding_has_no_contradiction():
    r = np.random.default_rng(8)
    page = html.Page(html.training_pages(1, 5)[0][0])
    for _ in range(20):
        margin = r.normal(size=len(page.tag)) * 3
        kept = html.decode(page, margin)
        assert all(not kept[i] or kept[page.parent[i]] for i in range(1, len(kept)))


def test_piece_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    assert packing.piece_encoder(path) is not None
    tk, mine, r = Tokenizer.from_file(path), packing.word_ids(path), random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'.,!?-_\x1c\x7fàéîõüßÿÀÉß漢ſİΣσς́ǅ½²ªµ"
    words = ["".join(r.choice(letters[:k]) for _ in range(r.randint(1, 14))) for k in (26, 52, 70, 80, len(letters)) for _ in range(3000)]
    words += ["don't", "we're", "'s", "!'s", "x'll'd", "<|endoftext|>a", "a<|startoftext|>", "<|x"]
    for w, e in zip(words, tk.encode_batch(words, add_special_tokens=False), strict=True):
        assert mine(w.encode()) == np.asarray(e.ids, "<u4").tobytes(), w
