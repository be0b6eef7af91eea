"""Archives, periodic runs and the filter audit against plain loops."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import audit, periodic, warc
from textmill.llm.common import stored
from textmill.session import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _part int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 7, "k") for i, t, s in rows], DOCS)


# --- archives ------------------------------------------------------------------

LONG = "<p>" + "x" * 120 + "</p>"
PAGES = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, "http://a/9", LONG), (3, "http://a/0", LONG), (None, "http://a/n", LONG),
    (1, "http://b/ 1\r\nX: y", "short"), (2, None, "short"), (4, "http://b/4", None), (6, "http://b/6", ""),
    (7, "http://c/é", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "日本" * 60), (8, "http://c/8", LONG + "é"),
    (10, "http://d", LONG + "z"), (10, "http://d", LONG + "z"), (10, "http://d", LONG + "z"), (11, "http://d", LONG + "z"),
    (12, "http://e", "y" * 3_000_000), (13, "http://e", "a" * 99), (14, "http://e", "a" * 99), (15, "http://e", "b" * 100), (16, "http://e", "b" * 100),
]


def archived(spark, rows, **options):
    pages = spark.createDataFrame([(*row, 7, "k") for row in rows], "page_id long, url string, html string, _part int, digest string")
    folder = new_folder(spark, "archives")
    warc.write_archives(pages, folder, **options)
    return folder


def test_archives_hold_every_page_once(spark):
    folder = archived(spark, PAGES, archive_bytes=5000)
    records = stored(warc.read_archives(spark, folder), "records")
    found = warc.with_originals(records).collect()
    first = {}
    for page_id, url, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0], p[1] is None, p[1])):
        first.setdefault((html or "").encode(), page_id)
    want, seen = Counter(), set()
    for page_id, url, html in sorted(PAGES, key=lambda p: (p[0] is None, p[0], p[1] is None, p[1])):
        data = (html or "").encode()
        again = len(data) >= 100 and data in seen
        seen.add(data)
        uri = url and re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url)
        want[page_id, uri, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None] += 1
    assert Counter((r.page_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == want
    assert len({r.record_id for r in found}) == len(PAGES)
    for r in found:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest
    assert len({r.path for r in found}) > 4


def test_archives_are_warc(spark):
    """A reader of its own that knows only the format."""
    folder = archived(spark, PAGES[:12])
    count = 0
    for (content,) in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content").collect():
        while content:
            head, rest = bytes(content).split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields)
            length = int(fields["Content-Length"])
            assert rest[length:length + 4] == b"\r\n\r\n"
            if fields["WARC-Type"] == "revisit":
                assert fields["WARC-Refers-To"].startswith("<urn:uuid:") and fields["WARC-Profile"].endswith("identical-payload-digest")
            content = rest[length + 4:]
            count += 1
    assert count == 12


def test_archives_repeat_and_fail_loudly(spark):
    ids = [
        sorted(r.record_id for r in warc.read_archives(spark, archived(spark, rows), with_payload=False).collect())
        for rows in (PAGES, PAGES[::-1])
    ]
    assert ids[0] == ids[1]
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha256:0\r\nContent-Length: 9\r\n\r\n"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records_of("f", good + b"abc", True))
    with pytest.raises(ValueError, match="digest"):
        list(warc.records_of("f", good + b"h\r\n\r\nabcd\r\n\r\n", True))
    with pytest.raises(ValueError, match="not a record"):
        list(warc.records_of("f", b"GIF89a\r\n\r\n", True))
    empty = warc.read_archives(spark, archived(spark, []))
    assert warc.with_originals(empty).count() == 0


# --- periodic runs ---------------------------------------------------------------

def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(6, 4 * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def random_text(rng):
    n, letters = rng.choice([0, 3, 6, 7, 50, 200, 500]), rng.choice([1, 2, 3, 10])
    words = [rng.randrange(letters) for _ in range(n)]
    if n > 20 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(3, 10)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        for text, runs in zip(texts, periodic.find_runs([np.array(t, np.int64) for t in texts])):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(text)


def test_grammar_answers_extensions():
    """Every pair of places of a text, forwards and backwards."""
    rng = random.Random(6)
    for letters in (1, 2, 5):
        text = [1000, *(rng.randrange(letters) for _ in range(70)), *[0] * 20, *[0, 1] * 15, 1001]
        levels = periodic.recompress(np.array(text))
        assert len(levels[-1].symbols) <= periodic.FEW or letters == 1
        n = len(text)
        i, j = (np.array(x) for x in zip(*itertools.combinations(range(n), 2)))

        def common(a, b):
            k = 0
            while b + k < len(a[0]) and a[0][a[1] + k] == a[0][b + k]:
                k += 1
            return k

        ahead = [common((text, x), y) for x, y in zip(i, j)]
        assert periodic.agree(levels, i, j).tolist() == ahead
        back = [common((text[::-1], n - 1 - y), n - 1 - x) for x, y in zip(i, j)]
        assert periodic.agree([level.reversed() for level in levels], n - 1 - i, n - 1 - j).tolist() == back


def test_long_texts_are_linear_enough():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 200_000:
        fib.append(fib[-1] + fib[-2])
    same, mixed = np.zeros(200_000, np.int64), np.where(np.arange(200_000) % 2 == 0, 0, np.arange(200_000) + 1)
    ends = np.concatenate([np.arange(100_000), np.tile(np.arange(20_000), 5)])
    got = periodic.find_runs([same, mixed, np.array(fib[-1]), ends])
    assert [r.tolist() for r in got] == [[[0, 200_000, 1]], [], [], [[100_000, 100_000, 20_000]]]


def test_run_columns(spark):
    texts = ["a b " * 5 + "c", None, "", " \x0b\t", "x " * 9 + "y y y y y y", "é é é é é é", "one two", "w " * 60_000, "a b " * 5 + "c"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("runs", F.lit("clash"))
    rows = {r.doc_id: r for r in periodic.with_runs(docs).collect()}
    assert [c for c in docs.columns if c != "runs"] == periodic.with_runs(docs).columns[:-3]
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        assert [tuple(r) for r in rows[i].runs] == runs and rows[i].n_words == len(words)
        assert rows[i].collapsed == " ".join(w for k, w in enumerate(words) if k not in gone)
    assert periodic.with_runs(docs.limit(0)).count() == 0


def test_run_digests(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{x}" for x in random_text(rng)), "s") for i in range(400)] + [(None, "a a a a a a a", "s"), (-4, None, "s")]
    found = {r.doc_id: r for r in periodic.digests(periodic.with_runs(periodic.planted(docs_of(spark, rows)))).collect()}
    changed = 0
    for doc_id, text, _ in rows:
        words = WORD.findall(text or "")
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, = [g % n]
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(words)
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        row = found[doc_id]
        best = None
        for s, length, q in runs:
            if best is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        assert (row.start, row.length, row.period) == (best or (None, None, None))
        assert row.exponent_milli == (best and 1000 * best[1] // best[2]) and row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in gone).encode()).hexdigest()
    assert changed > 20


# --- filter audit ----------------------------------------------------------------

def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    failing = []
    for doc_id, text, source in rows:
        text = text or ""
        words = WORD.findall(text)
        smallest = first.get(text)
        verdicts = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": smallest is not None and (doc_id is None or smallest < doc_id),
        }
        failing.append((source or "", {f for f, v in verdicts.items() if v}, doc_id))
    out, shapley = {}, Counter()
    for part in {source for source, _, _ in failing}:
        own = [(fails, doc_id) for source, fails, doc_id in failing if source == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                lost = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                shapley[part, f] += len(lost)
                out[part, order, step] = (
                    len(left), len(lost), sum(f in fails for fails, _ in own) - len(lost), sum(fails == {f} for fails, _ in own),
                    sum(i in good for _, i in lost), sum(i in toxic for _, i in lost))
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        n = rng.choice([0, 3, 49, 50, 60, 80])
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d#", "é"]) if rng.random() < 0.4 else f"w{rng.randrange(200)}" for _ in range(n)]
        rows.append((i, " ".join(words), rng.choice(["s1", "s2", None, ""])))
    copies = "same text in many documents " * 12
    rows += [(300 + i, copies, "s1" if i % 3 else None) for i in range(60)]
    rows += [rows[7], rows[7], (None, copies, "s2"), (None, "only here", "s2"), (None, "only here", "s2"), (400, None, "s3"), (401, "", "s3")]
    labels = [(i, i % 2, i % 3) for i in range(0, 360, 2)] + [(2, 0, 1), (4, 1, 0), (None, 1, 1), (7, None, 1), (7, 1, None)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(docs_of(spark, rows), frame)
    want = plain_audit(rows, labels)
    assert found.count() == 600 * len({p for p, _, _ in want}) == len(want)
    for r in found.collect():
        got = tuple(r[c] for c in audit.FIGURES)
        assert got == want[r.part, r.filter_order, r.step], (r.part, r.filter_order, r.step)
        assert r["filter"] == r.filter_order[r.step - 1]
    assert audit.audit(docs_of(spark, rows).limit(0), frame).count() == 0
    assert audit.audit(docs_of(spark, rows), frame.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


# --- spans of long texts -----------------------------------------------------------

def test_tagged_spans_against_plain_ones():
    from textmill.llm import secrets

    rng = random.Random(9)
    for _ in range(60):
        words = [rng.choice(["é日", "word", "AKIA" + "A" * 20, "0a" * 14, "token=abcdef12", "x"]) for _ in range(40)]
        text = " ".join(words)
        raw, marks = text.encode(), []
        for m in re.finditer(rb"\S+", raw):
            if rng.random() < 0.3:
                marks.append(m.span())
        base = secrets.base_spans(text)
        want = []
        for s, e in marks:
            low, high = len(raw[:s].decode()), len(raw[:e].decode())
            if all(high <= start or end <= low for start, _, end in base):
                want.append((low, secrets.KINDS.index("crf"), high))
        assert secrets.find(text, marks) == (base, sorted(base + want))
    long = "é x " * 200_000
    spans = [(m.start(), m.end()) for m in re.finditer(rb"x", long.encode())]
    assert len(secrets.find(long, spans)[1]) == 200_000


def test_exception_phrases_against_plain_ones():
    from textmill.llm import toxicity

    lexicon = toxicity.Lexicon({" bad": 1.0, " worse ": 2.0}, ["not bad", "bad luck", "no worse than"], None)
    rng = random.Random(10)
    for _ in range(60):
        words = [rng.choice(["not", "bad", "badly", "luck", "worse", "no", "than", "x"]) for _ in range(30)]
        text = f" {' '.join(words)} "
        spans = lambda part: [m.span(1) for m in re.finditer(f"(?=({re.escape(part)}))", text)]
        spared = [s for p in lexicon.exceptions for s in spans(f" {p} ")]
        want = sorted((s, w) for entry, w in lexicon.weights.items() for s, e in spans(entry)
                      if not any(a <= s and e <= b for a, b in spared))
        assert sorted(lexicon.matches(words)) == want
    assert len(lexicon.matches(["bad", "luck", "bad", "x"] * 100_000)) == 100_000
