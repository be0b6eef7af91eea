"""SimHash, exact search, repeated strings, main text, secrets and toxicity against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entries
from textmill.llm import nearest, repeats, secrets, simhash, templates, toxicity
from textmill.llm.queries import QUERIES

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def odd_texts():
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") * rng.randint(1, 7) for _ in range(400))
    near = [base.replace("a", "b", n) for n in range(3)] + [base + " x" * n for n in range(3)]
    return [
        None, "", " \n\t ", "one", "one two", "ONE two", "one two three", base, base, base.upper(), *near,
        "token = \"0123456789abcdef0123456789abcdef\" and more", "word " * 30_000, "é日\U0001f600 " * 50,
        "x" + base + "y", "ab" * 600, "idiot " * 3, "1d10t moron",
    ]


def odd_docs(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(odd_texts())]
    rows += [rows[7], rows[7], (None, rows[7][1], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def tables(spark):
    return {"odd": odd_docs(spark), "table": spark.read.parquet(f"{MEDIUM}/documents.parquet")}


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = SPACES.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    ids = sorted({f for _, f in rows})
    root = {f: f for f in ids}

    def up(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[up(a)] = up(b)
    first = defaultdict(list)
    for d, f in rows:
        first[up(f)].append(d)
    return {f: min((d for d in first[up(f)] if d is not None), default=None) for f in ids}


@pytest.mark.parametrize("which", ["odd", "table"])
def test_simhash(spark, tables, which):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in tables[which].collect()]
    names = plain_components(rows)
    found = simhash.classes(simhash.fingerprints(tables[which]))
    got = Counter((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in found.collect())
    assert got == Counter((d, f, names[f]) for d, f in rows)
    kept = simhash.one_of_each(tables[which])
    assert kept.columns == tables[which].columns
    assert Counter(plain_fingerprint(r.text) for r in kept.collect()).total() == len(set(map(str, plain_groups(rows, names))))


def plain_groups(rows, names):
    # Components without an id are told apart by their fingerprint class.
    return [names[f] if names[f] is not None else ("none", f) for _, f in rows]


def test_crowded_shards(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 700:
        f = rng.choice(sorted(prints)[:50])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(i, "", f) for i, f in enumerate(signed)], "doc_id long, text_id string, fingerprint long")
    names = plain_components([(i, f % (1 << 64)) for i, f in enumerate(signed)])
    for largest in (40, 2000):
        got = {r.fingerprint % (1 << 64): r.component_id for r in simhash.classes(frame, largest=largest).collect()}
        assert got == names


def test_empty_simhash(spark, tables):
    assert simhash.classes(simhash.fingerprints(tables["odd"].limit(0))).count() == 0
    assert simhash.one_of_each(tables["odd"].limit(0)).count() == 0


def plain_top(rows, every, k):
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in rows if i is not None and x and all(c is not None and np.isfinite(c) for c in x)}
    for q in v:
        if q % every == 0:
            scored = sorted((-int(v[q] @ v[i]), i) for i in v if i != q and len(v[i]) == len(v[q]))[:k]
            yield from ((q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1))


@pytest.mark.parametrize("which", ["odd", "table", "clusters", "few"])
def test_top_k(spark, which):
    rng = np.random.default_rng(1)
    if which == "table":
        frame = spark.read.parquet(f"{MEDIUM}/embeddings.parquet")
    else:
        same = [0.5, -0.25, 1.0, 0.0]
        rows = {
            "odd": [(0, None), (1, [None, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf")]), (None, [1.0]), (50, same), (4, []),
                    *((i, same) for i in range(5, 30)), (100, [1.0, 2.0]), (101, [1.0]), (150, [0.0] * 4), *((i, rng.normal(size=4).tolist()) for i in range(200, 300))],
            "clusters": [(i, (rng.normal(size=8) * 0.02 + 10 * np.eye(8)[i % 8]).tolist()) for i in range(1000)],
            "few": [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [0.1, -2.0])],
        }[which]
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = sorted(plain_top([(r.vec_id, r.embedding) for r in frame.collect()], 50, 5))
    assert sorted(map(tuple, nearest.top_k(frame).collect())) == expected
    assert nearest.top_k(frame.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact at every size; only an answer that leaves 64 bits is an error."""
    def answers(rows):
        frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        return sorted(map(tuple, nearest.top_k(frame).collect()))

    def exact(rows):
        whole = [(i, [int(256 * x // 1) if abs(x) < 2**44 else 256 * int(x) for x in v]) for i, v in rows]
        out = []
        for i, v in whole:
            if i % 50 == 0:
                best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:5]
                out += [(i, rank, j, -score) for rank, (score, j) in enumerate(best, 1)]
        return sorted(out)

    for x in (2.0**10, 2.0**18 + 0.3, 2.0**22):
        rows = [(50, [x, 1]), (1, [x, 0]), (2, [1, 1]), (3, [-x, 0]), (4, [x, 0.5]), (5, [x, -3]), (6, [x / 3, x]), (100, [0, 1])]
        assert answers(rows) == exact(rows)
    # Large components whose scores fit, and scores far below 64 bits that no answer needs.
    rows = [(50, [1 / 256, 0.0]), (1, [2.0**41, 7]), (2, [-(2.0**50), 1]), (3, [1.0, 2.0**300])]
    assert answers(rows) == exact(rows)
    near = [(i, [1.0, float(i)]) for i in range(1, 7)]
    rows = [(50, [2.0**26, 1.0]), *near, (7, [-(2.0**38), 0.0]), (8, [-1e300, 0.0])]
    assert answers(rows) == exact(rows)
    for v in ([2.0**38, 0.0], [1e305, 1.0], [1.7e308, 0.0]):
        with pytest.raises(Exception, match="leaves 64 bits"):
            answers([(50, [2.0**26, 1.0]), *near, (9, v)])


def test_every_query_row_is_answered(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [3.0, 1.0]), (2, [1.0, 3.0]), (2, [1.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = Counter(map(tuple, nearest.top_k(frame).collect()))
    one = lambda *scores: [(50, rank, *x) for rank, x in enumerate(scores, 1)]
    right = one((2, 3 * 65536), (2, 3 * 65536), (1, 65536))
    assert found == Counter([*one((1, 3 * 65536), (2, 65536), (2, 65536)), *right, *right])


def plain_repeats(rows, least):
    raw = [(r.text or "").encode() for r in rows]
    often = Counter(t[i:i + least] for t in raw for i in range(len(t) - least + 1))
    for row, t in zip(rows, raw):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - least + 1):
            if often[t[i:i + least]] > 1:
                gone[i:i + least] = True
        spans = int((gone[1:] < gone[:-1]).sum())
        yield row.doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])).hexdigest()


@pytest.mark.parametrize("which, least, crowded", [("odd", 400, 1 << 16), ("odd", 12, 1 << 16), ("odd", 40, 100), ("table", 400, 1 << 16), ("table", 400, 1000)])
def test_repeats(tables, which, least, crowded):
    got = Counter(tuple(r)[:5] for r in repeats.repeats(tables[which], least, crowded).collect())
    assert got == Counter(plain_repeats(tables[which].collect(), least))


def test_no_repeats(tables):
    assert repeats.repeats(tables["odd"].limit(0)).count() == 0
    assert [r.n_removed for r in repeats.repeats(tables["odd"].filter("doc_id = 7").limit(1)).collect()] == [0]


def test_planted_passages(spark):
    rng = random.Random(8)
    words = lambda size: "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
    long, short, whole = words(450), words(399), words(700)
    texts = [words(900) for _ in range(8)]
    for i in (0, 1, 2):
        texts[i] = f"{texts[i][:300 + i]}<{i}{long}{i}>{texts[i][300 + i:]}"
    for i in (3, 4):
        texts[i] = f"{texts[i][:200]}<{i}{short}{i}>{texts[i][200:]}"
    # A text that is there twice, and once more inside another one.
    texts += [whole, whole, f"{words(50)}<{whole}>{words(500)}"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    for crowded in (1 << 16, 500):
        got = repeats.repeats(docs, 400, crowded).collect()
        assert Counter(tuple(r)[:5] for r in got) == Counter(plain_repeats(docs.collect(), 400))
        assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)] == [450] * 3 + [0] * 5 + [700] * 3


def test_long_periods_are_few_rows(spark, monkeypatch):
    """A period that goes on in many contexts has as many segments as windows, of which few differ."""
    rng = random.Random(9)
    words = lambda size: "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
    texts = [f"{words(60)}{'buy now ' * (70 + i)}{words(60)}" for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    made, stored = {}, repeats.stored

    def counted(rows, name):
        out = stored(rows, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    got = repeats.repeats(docs, 400, 500).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(plain_repeats(docs.collect(), 400))
    # A row for every place made 1,630; windows that are cut one by one differ in few ways per text.
    assert 0 < made["parts"] < 300


def test_transform_against_loops():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.choice([b"ab", b"abc", b"a", bytes(range(256))])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        texts.append(texts[0][:15] + texts[-1])
        least = rng.randint(1, 8)
        often = Counter(t[i:i + least] for t in texts for i in range(len(t) - least + 1))
        expected = [[i for i in range(len(t) - least + 1) if often[t[i:i + least]] > 1] for t in texts]
        assert [x.tolist() for x in repeats.repeated_starts(texts, least)] == expected


PAGES = [
    "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div class='ad'>Buy!</div><article><h1>A &amp; B</h1><p>First  \n line<br>more <b>bold</b>.<p>Second &eacute;<div>Third</div></article>"
    "<section class='comments'><p>Nice</p></section><aside>Side</aside><form><input><label>x</label></form><footer>&copy; Site</footer></body></html>",
    "<body><div id=menu><a href=/>Home</a></div><div id=content><p>Long text about things that matter.</p><p>More of it.</p></div>"
    "<div class='cookie-notice'>We use cookies</div><script>var a = '<p>no</p>';</script><!-- <p>no</p> --></body>",
    None, "", "plain text only", "<article><p>Unclosed <b>bold <article class=comment><p>no</article><p>yes", "<<>> &lt;tag&gt; a < b",
]
TEXTS = [
    "A & B\n\nFirst line more bold.\n\nSecond é\n\nThird", "Long text about things that matter.\n\nMore of it.",
    "", "", "plain text only", "Unclosed bold\n\nyes", "<<>> <tag> a < b",
]


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", p) for i, p in enumerate(PAGES)] + [(0, "http://h0.example/0", PAGES[0]), (None, None, PAGES[1])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = templates.main_text(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id is not None} == dict(enumerate(TEXTS))
    assert templates.main_text(frame.limit(0)).count() == 0


def test_main_text_of_the_table(spark):
    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for row in templates.main_text(pages).collect():
        article = re.search(r"<article>(.*?)</article>", html[row.page_id], re.S)[1]
        blocks = [" ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        import html as markup
        assert row.text == "\n\n".join(markup.unescape(b) for b in blocks if b)


def test_classes_of_a_host(spark):
    frame = spark.createDataFrame([(i, "http://a.b/", f"<body><nav>x</nav><article>{'<p>t</p>' * (i + 1)}</article></body>") for i in range(4)], "page_id long, url string, html string")
    template = templates.templates(templates.occurrences(frame)).first().template
    classes = defaultdict(set)
    for m in template:
        classes[m["class"]].add(m.token)
    assert sorted(map(len, classes.values())) == [2, 6]


def full_viterbi(field, code):
    score = field.emission[code[0]].copy()
    best = [[t] for t in range(3)]
    for c in code[1:]:
        paths = score[:, None] + field.transitions
        come = paths.argmax(axis=0)
        best = [[*best[come[t]], t] for t in range(3)]
        score = paths.max(axis=0) + field.emission[c]
    return best[int(score.argmax())]


def test_secret_field(spark, tables):
    texts = secrets.sample(tables["table"])
    field = secrets.fit(texts)
    found = secrets._crf_spans(field, [b'password: "A9F3C21B77E04D5581AA3C0FE1B2D3C4A9F3C21B" is here', b"an ordinary line of words, nothing else"])
    assert len(found[0]) == 1 and found[1] == []
    for text in texts[:60]:
        code, _ = secrets._silver(text)
        doc = np.zeros(len(code), int)
        if len(code):
            assert field.tags(code, doc).tolist() == full_viterbi(field, code)
    two = [t.encode() for t in texts[:6]]
    assert secrets._crf_spans(field, two) == [secrets._crf_spans(field, [t])[0] for t in two]


def plain_spans(text):
    text = text or ""
    found = []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    for kind, pattern, group, least in (
        ("assign", rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), ("assign", "access", "hex").index(kind), m.end(), kind))
    return sorted(found)


@pytest.mark.parametrize("which", ["odd", "table"])
def test_secrets(spark, tables, which):
    docs = tables[which]
    if which == "odd":
        more = ["TOKEN=abc12", "Api_Key : 'abcdef'", "AKIA" + "Z9" * 10, "é\U0001f600 secret=ſecret passwd='aaaaaa'", "0" * 24 + "g" + "f" * 23]
        docs = docs.union(spark.createDataFrame([(900 + i, t, None, None, None) for i, t in enumerate(more)], DOCS))
    texts = Counter()
    for r in docs.collect():
        spans = plain_spans(r.text)
        kinds = [s[3] for s in spans]
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        texts[r.doc_id, kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined.encode()).hexdigest()] += 1
    rows = secrets.scan(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == texts
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not any(plain_spans(r.text) for r in clean.collect())
    assert secrets.scan(docs.limit(0)).count() == 0


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    tested = [(rows[d], t) for d, t in truth.items() if rows[d].held_out]
    assert sum(r.predicted == t for r, t in tested) / len(tested) > 0.9
    other = labels.withColumn("toxic", labels.toxic + 0).filter(~toxicity.held_out())
    assert toxicity.learn(docs, other).weights == lexicon.weights


def test_folding():
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " lowei": 2.0}, ["no idiot"], (-1.0, 1.0, 0.0))
    words = toxicity.fold("1D10T! іdіоt, ｉdíot and löweiß; no idiot$")
    assert [w for _, w in lexicon.matches(words)] == [3.0, 3.0, 3.0, 2.0]
    assert lexicon.score("") < 0.5 < lexicon.score("idiot")


def test_toxicity_without_labels(spark, tables):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = toxicity.score(tables["odd"], toxicity.learn(tables["odd"], none)).collect()
    assert len(scored) == tables["odd"].count() and all(r.score == 0 and r.predicted == 0 for r in scored)
    assert toxicity.score(tables["odd"].limit(0), toxicity.Lexicon({})).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_pipeline(spark):
    import corpus_pipeline
    from textmill.llm.common import stored

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    out = entries.queries()["pipeline"](spark, SMALL)
    assert out.count() == counts[4] and out.filter("size(ids) <> n_tokens").count() == 0


def test_pipeline_on_odd_rows(spark):
    import corpus_pipeline

    odd = odd_docs(spark).selectExpr("*", "'x' as size", "1 as measures", "2 as count", "3 as ids0", "4 as spot")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            assert out.count() >= 0
            assert stage is corpus_pipeline.STAGES[-1][1] or out.columns == docs.columns
