"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import re
from collections import Counter

import pytest

from kinetrace.llm import fingerprints, licenses, minhash, mixing, pieces, quality_model, quality_rules, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, size long, words string, score double, node long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(4000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "a b c d e f g h i j"), (7, "a b c d e f g h i j"), (8, LONG), (9, LONG + " end"),
    (10, "x" * 3000), (11, "be " * 400), (None, "no id here at all, really"), (None, None), (12, "é€😀 ▁ ▁▁ \0 mixed"), (6, "a b c d e f g h i j"),
    (13, "Some text first.\nReleased under the MIT License.\nThis is more."), (14, "### *** $$$ | | |"),
]


def documents(spark, texts=TEXTS):
    rows = [(i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t), "l", 7, "w", 0.5, 3) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (8, 1, 0), (8, 0, 0), (11, 0, 1)], "doc_id long, quality int, toxic int")


ALL = {
    "fingerprints": lambda d, y: fingerprints.fingerprints(d),
    "mixture": lambda d, y: mixing.mixture(d),
    "licenses": lambda d, y: licenses.license_scan(d),
    "quality model": lambda d, y: quality_model.quality_scores(d, y),
    "suffix dedup": lambda d, y: suffix_dedup.suffix_dedup(d),
    "pieces": lambda d, y: pieces.round_trip(d),
    "toxicity": lambda d, y: toxicity.toxicity_scores(d, y),
    "minhash": lambda d, y: minhash.near_duplicates(d),
    "quality rules": lambda d, y: quality_rules.quality_rules(d),
}


@pytest.mark.parametrize("name", ALL)
def test_a_row_for_every_row(docs, labels, name):
    got = ALL[name](docs, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in TEXTS)


@pytest.mark.parametrize("name", ALL)
def test_empty_tables(spark, docs, labels, name):
    assert ALL[name](docs.limit(0), labels.limit(0)).collect() == []


def test_deduplicated_with_any_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id long, text string, _gone int, g int")
    assert [tuple(r) for r in minhash.deduplicated(docs).collect()] == [(1, "a b c d e f", 1, 2)]


STAGES = {
    "good documents": lambda d, y: quality_model.good_documents(d, y),
    "deduplicated": lambda d, y: minhash.deduplicated(d),
    "without repeats": lambda d, y: suffix_dedup.without_repeats(d),
    "mixed": lambda d, y: mixing.mixed_documents(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    out.collect()
    assert STAGES[name](docs.limit(0), labels).collect() == []


def test_fingerprints_against_python(spark, docs):
    got = fingerprints.fingerprints(docs).collect()
    order = sorted((t for t in TEXTS if t[0] is not None), key=lambda t: -t[0])
    texts = {i: t or "" for i, t in order}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    ids = sorted(texts, reverse=True)
    for r in got:
        i = r["doc_id"]
        if i in (None, 6, ids[-1]):  # null ids and the repeated id stand beside each other
            continue
        nxt = ids[ids.index(i) + 1] if i != 7 else 6
        t = texts[i]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[nxt][:cut]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert r["n_chars"] == len(t)
    same = {r["fingerprint"] for r in got if r["doc_id"] in (6, 7)}
    assert len(same) == 1
    # two texts that share a run of K + WINDOW - 1 words share a hash
    run = " ".join(f"q{i}" for i in range(fingerprints.K + fingerprints.WINDOW - 1))
    two = documents(spark, [(1, f"a b c {run} d e f"), (2, f"u v {run} x y z")])
    a, b = (set(r["fingerprint"].split()) for r in fingerprints.fingerprints(two).collect())
    assert a & b
    # positions are of grams with the least hash of a window: every window of a long text has one
    r = next(r for r in got if r["doc_id"] == 8)
    gaps = [y - x for x, y in zip(r["positions"], r["positions"][1:], strict=False)]
    assert max(gaps) <= fingerprints.WINDOW


def test_fingerprints_against_brute_force(spark):
    """Words, gram hashes (xxHash64 with seed 42, chained), windows, rightmost least, and likeness, by plain loops."""
    import xxhash

    texts = [(i, t) for i, (_, t) in enumerate(TEXTS)] + [(100 + i, f"{LONG[:3000]} {i}") for i in range(3)]
    k, w = fingerprints.K, fingerprints.WINDOW

    def marks(text):
        words = re.findall("[^\\x20\\x09-\\x0d]+", text)
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in words]
        grams = []
        for i in range(max(1, len(h) - k + 1) if h else 0):
            seed = 42
            for x in h[i : i + k]:
                seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=seed)
            grams.append(seed & 0x7FFFFFFF)
        found = []
        for i in range(max(1, len(grams) - w + 1) if grams else 0):
            at = min(range(i, min(i + w, len(grams))), key=lambda j: (grams[j], -j))
            if (at, grams[at]) not in found[-1:]:
                found.append((at, grams[at]))
        return [a for a, _ in found], list(dict.fromkeys(g for _, g in found))

    def like(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0

    got = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, texts)).collect()}
    order = sorted(got, reverse=True)
    by_id = {i: t or "" for i, t in texts}
    for n, i in enumerate(order):
        text, after = by_id[i], by_id[order[(n + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        at, own = marks(text)
        _, changed = marks(edited)
        r = got[i]
        assert r["n_chars"] == len(text) and r["positions"] == at and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{x:x}" for x in own) and r["edited_fingerprint"] == " ".join(f"{x:x}" for x in changed)
        assert abs(r["near_edited"] - like(own, changed)) < 1e-12 and abs(r["near_next"] - like(own, marks(after)[1])) < 1e-12


def test_targets_by_filling(spark):
    texts = [(i, "w " * n) for i, n in enumerate([1, 2, 400, 300, 20, 7, 50, 90])]
    rows = [(i, t, "en", s, 1, "l", 1, "w", 0.1, 1) for (i, t), s in zip(texts, ["a", "a", "b", "c", "d", None, "e", "é"], strict=True)]
    got = mixing.mixture(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = Counter()
    for (_, t), r in zip(texts, rows, strict=True):
        sizes[r[3]] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        s = rows[r["doc_id"]][3]
        assert abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == sizes[s]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(spark.createDataFrame(rows[::-1], SCHEMA)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_sainte_lague_against_the_plain_method(spark):
    import random

    random.seed(4)
    for seats in (0, 1, 7, 100):
        votes = [random.choice([0, 1, 5, 37, 400]) for _ in range(12)]
        claims = spark.createDataFrame([("g", k, float(v), seats) for k, v in enumerate(votes)], "g string, k long, v double, s long")
        got = {r["k"]: r["quota"] for r in mixing.sainte_lague(claims, "g", "k", "v", "s").collect()}
        want = Counter()
        for _ in range(seats):
            if sum(votes):
                want[max(range(12), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))] += 1
        assert got == {k: want[k] for k in range(12)}


def test_mixed_documents_have_the_words_taken(spark, docs):
    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_licenses(docs):
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    assert got[13]["license"] == "MIT" and got[13]["dice"] == 1.0 and got[13]["n_units"] == 1
    assert got[4]["license"] is None and got[4]["licenses"] == ""


def test_common_licenses_and_full_texts(spark):
    texts = [(1, "Some text.\nLicensed under CC BY-NC 4.0.\nMore."), (2, licenses._MIT), (3, "Copyright 2020 X\n" + licenses._GNU.format("program is free software: you can", "GNU General Public License", "3", "program", "General Public").replace(", ", ",\n"))]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1]["license"] == "CC-BY-NC-4.0" and got[1]["dice"] == 1.0
    assert got[2]["license"] == "MIT" and got[2]["dice"] == 1.0
    assert got[3]["license"] == "GPL-3.0" and got[3]["dice"] > 0.95 and got[3]["licenses"] == "GPL-3.0"


def test_every_template_is_found_and_no_rival(spark):
    """Each template in a document of its own, changed a little, is its license and no other is named; other prose has none."""
    rows = [(i, f"Some words before it.\n{text.replace('.', ' .', 1)} xx\nAnd some words after.") for i, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(1000, "A license is what a park asks of dogs.\nPermission is granted to walk here, free of charge."), (1001, "the general public enjoys a free library")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        assert got[i]["license"] == name and name in got[i]["licenses"].split(","), (name, got[i])
        assert len(got[i]["licenses"].split(",")) == 1 or got[i]["dice"] < 1
    assert got[1000]["license"] is None and got[1001]["license"] is None


def brute_windows(text, templates):
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    found = {}
    for name, notice in templates:
        t = set(licenses.bigrams(notice))
        for i in range(len(grams)):
            for j in range(i + 1, min(len(grams), i + licenses.bounds(len(t))[1]) + 1):
                a = set(grams[i:j])
                if (dice := 2 * len(a & t) / (len(a) + len(t))) >= 0.75:
                    found[name] = max(found.get(name, 0), dice)
    return found


def test_license_windows_equal_brute_force(spark):
    filler = "alpha beta of the gamma to the delta any purpose " * 4
    wrapped = re.sub(r"((?:\S+ ){7})", r"\1\n", licenses._ISC)
    texts = [
        (1, f"{filler} we say: Released under the MIT License. {filler}"), (2, f"{filler}\n{wrapped}\n{filler}"), (3, "Copyright (c) 2020 X. All rights reserved. Do not copy."),
        (4, filler), (5, None), (6, "the mit license released under the terms"), (7, f"{filler} licensed under the gnu the general public license version 3 or {filler}"), (8, "one"),
    ]
    got = {r["doc_id"]: r for r in licenses.license_windows(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        want = brute_windows(text or "", licenses.TEMPLATES)
        assert got[i]["licenses"] == ",".join(sorted(want))
        assert (got[i]["license"], got[i]["dice"]) == (min((-d, n) for n, d in want.items())[::-1][0], max(want.values())) if want else got[i]["license"] is None
    assert got[1]["license"] == "MIT" and got[2]["license"] == "ISC" and got[3]["license"] == "Proprietary"


def test_thresholds_follow_the_source(spark):
    """A share of symbols that is normal in one source is out of the way in another; a small source takes its language's fences."""
    prose = " ".join(f"word{i}" for i in range(80))
    rows = [(i, prose + " |" * (6 + i % 3), "en", "tables") for i in range(150)] + [(1000 + i, prose, "en", "prose") for i in range(850)]
    rows += [(5000, prose + " |" * 6, "en", "prose"), (5001, prose + " |" * 6, "en", "small"), (5002, prose + " |" * 200, "en", "tables"), (5003, prose, "en", "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert got[0]["kept"] and not got[5000]["kept"] and not got[5002]["kept"] and got[5003]["kept"]
    assert got[0]["max_symbols"] > got[1000]["max_symbols"] and got[5001]["max_symbols"] != got[5000]["max_symbols"]


def brute_repeats(texts):
    n = suffix_dedup.LENGTH
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for (doc, _), b in zip(texts, data, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def repetitive_texts():
    import random

    random.seed(2)
    word = lambda: "".join(random.choice("abcdé") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [(i, " ".join(word() for _ in range(random.randrange(80)))) for i in range(20)]
    texts += [(100 + i, f"{word()} {passage[i * 9 :]} {word()} {passage[: 150 + 20 * i]}") for i in range(8)]
    texts += [(300 + i, f"{' '.join(word() for _ in range(50))} {passage[20:-20]} {' '.join(word() for _ in range(50))}") for i in range(12)]
    texts += [*TEXTS, (200, passage), (201, passage), (202, "ab" * 300), (203, ("abc" * 70)[:199]), (204, "xyz" * 67), (205, "xyz" * 67), (206, "é" * 150)]
    return texts


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = repetitive_texts()
    got = Counter(tuple(r) for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect())
    assert got == brute_repeats(texts)


def test_long_texts_in_slices(monkeypatch):
    import numpy as np

    texts = [t.encode() for _, t in repetitive_texts() if t]
    texts = [*texts, b" ".join(texts), b"ab" * 5000]
    n = np.arange(len(texts))
    whole = suffix_dedup.parse(texts, n, n.astype(np.int32), suffix_dedup.Rolling())
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 300)
    sliced = suffix_dedup.parse(texts, n, n.astype(np.int32), suffix_dedup.Rolling())
    assert len(whole) > 100 and sorted(whole.tolist()) == sorted(sliced.tolist())


def test_warc(spark, tmp_path):
    html = [(1, "http://a/1", "<p>x</p>"), (2, "http://b\r\nX: 1", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 400_000), (None, "u", "é" * 400_000), (7, "u", "a\r\n\r\nWARC/1.1\r\n"), (2, "http://c", "<p>x</p>")]
    pages = spark.createDataFrame([(*r, 9) for r in html], "page_id long, url string, html string, size long")
    got = warc.warc_round_trip(pages).collect()
    import base64

    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = Counter()
    for i, _, t in html:
        first = max((x for x, _, u in html if (u or "") == (t or "") and x is not None), default=None)
        want[(i, len((t or "").encode()), digest(t), "response" if i == first else "revisit", None if i == first else first)] += 1
    assert Counter(tuple(r) for r in got) == want
    from kinetrace.storage import new_path

    chunks = warc.read_chunks(warc.write_archives(pages.where("page_id = 5"), new_path(spark, "warc-test"))).where("record_type = 'response'").orderBy("chunk_no").collect()
    assert [c["chunk_no"] for c in chunks] == [0, 1, 2, 3] and b"".join(bytes(c["data"]) for c in chunks) == ("é" * 400_000).encode()
    assert chunks[0]["payload_digest"] == base64.b32encode(hashlib.sha1(bytes(chunks[0]["data"])).digest()).decode()
    assert warc.warc_round_trip(pages.limit(0)).collect() == []
    import gzip

    written = warc.write_archives(pages, f"file://{tmp_path}").collect()
    raw = b"".join(gzip.decompress(open(r["archive"].removeprefix("file://"), "rb").read()) for r in written)
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == sum(r["records"] for r in written) == len(html)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(set(ids)) == len(ids)  # one page has the same payload twice, and still an id for each
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", raw)) <= set(ids)


def test_warc_payloads_are_written_in_pieces(spark, monkeypatch, tmp_path):
    """No row that reaches the writer holds more than a piece, and a piece that is missing is noticed."""
    monkeypatch.setattr(warc, "CHUNK", 1000)
    sizes = [0, 1, 999, 1000, 1001, 25_000, 3_000_000]
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string")
    rows = pages.withColumn("payload", pages.html.cast("binary")).selectExpr("page_id", "octet_length(payload) AS size", "payload")
    pieces = [(r["page_id"], r["chunk_no"], len(r["piece"])) for r in warc._chunked(rows).collect()]
    assert pieces == [(i, k, min(1000, n - 1000 * k)) for i, n in enumerate(sizes) for k in range(max(-(-n // 1000), 1))]
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.warc_round_trip(pages).collect()}
    assert got == {i: (n, "response") for i, n in enumerate(sizes)}
    whole = warc._chunked
    monkeypatch.setattr(warc, "_chunked", lambda df: whole(df).where("chunk_no <> 1"))
    with pytest.raises(Exception, match="where 1 was expected|end before"):
        warc.write_archives(pages.where("page_id = 5"), f"file://{tmp_path}").collect()


def test_archives_of_others(spark, tmp_path):
    """Two versions, several members and none, folded lines, no digest, a wrong one, and blocks that are no HTTP messages."""
    import gzip

    def record(version, kind, block, *lines, content="application/http; msgtype=response"):
        return "\r\n".join([f"WARC/{version}", f"WARC-Type: {kind}", *lines, f"Content-Type: {content}", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: a\r\n  b\r\n\r\n<p>hi</p>\n"
    parts = [
        record("1.0", "warcinfo", b"software: other\r\n", content="application/warc-fields"),
        record("1.0", "response", http, "WARC-Record-ID: <urn:x:1>", "WARC-Target-URI:", " http://a/"),
        record("1.0", "request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http; msgtype=request"),
        record("1.1", "resource", b"\n\nplain block", "WARC-Payload-Digest: sha1:AAAA", content="text/plain"),
        record("1.1", "revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", "WARC-Payload-Digest: sha1:QQQQ"),
        record("1.1", "metadata", b"", content="text/plain"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "b.warc").write_bytes(b"".join(parts))
    read = lambda name: warc.read_chunks(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "archive string")).drop("archive").orderBy("record").collect()
    got = read("a.warc.gz")
    assert got == read("b.warc")
    assert [r["record_type"] for r in got] == ["warcinfo", "response", "request", "resource", "revisit", "metadata"]
    assert bytes(got[1]["data"]) == b"<p>hi</p>\n" and got[1]["target"] == "http://a/" and got[1]["warc_id"] == "<urn:x:1>" and got[1]["verified"] is None
    assert bytes(got[3]["data"]) == b"\n\nplain block" and got[3]["verified"] is False
    assert got[4]["payload_digest"] == "QQQQ" and got[4]["payload_bytes"] is None and got[5]["payload_bytes"] == 0


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def awkward_texts():
    import random

    random.seed(3)
    made = ["".join(random.choice(a) for _ in range(n)) for a in ("thenad", "thenandéß😀\0\n ▁xyz", "x", " ", "0123 in the er") for n in (1, 2, 63, 64, 65, 127, 128, 191, 400, 2000)]
    return [t for _, t in TEXTS if t] + made


def test_pieces_have_the_ids_of_the_library():
    e, sp = pieces.Encoder(pieces.Vocabulary(*pieces.load(pieces.default_model()))), library()
    for t in awkward_texts():
        ids = e.encode(t)
        assert ids.tolist() == sp.encode(t)
        assert e.decode(ids) == t.replace("▁", " ")
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        for chunk in (17, 50, 128):  # a chunk is at least as long as a piece
            rows = []
            for at in range(0, len(marked), chunk):
                begin = max(0, at - e.v.longest)
                rows.append((marked[begin : at + chunk + e.v.longest], at - begin, min(at + chunk, len(marked)) - begin))
            states = pieces.states_at_cuts([e.transfer(*r) for r in rows])
            assert [i for r, a, b in zip(rows, states, states[1:], strict=False) for i in e.trace(*r, a, b)] == sp.encode(t)


def test_giant_documents_in_chunks(spark):
    sp = library()
    texts = [*TEXTS, (6, "x" * 3000), (6, "x" * 3000), *((50 + i, t) for i, t in enumerate(awkward_texts()))]
    docs = documents(spark, texts)
    for chunk in (64, 1000):
        got = Counter((r["doc_id"], tuple(r["ids"])) for r in pieces.encoded(docs, chunk=chunk).collect())
        assert got == Counter((i, tuple(sp.encode(t or ""))) for i, t in texts)
    told = pieces.round_trip(docs, chunk=64).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["exact"]) for r in told) == Counter((i, len(t or ""), "▁" not in (t or "")) for i, t in texts)


def test_every_document_has_the_ids_of_the_library(spark):
    sp, docs = library(), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert {r["doc_id"]: r["ids"] for r in pieces.encoded(docs).collect()} == {r["doc_id"]: sp.encode(r["text"] or "") for r in rows}


def test_toxicity_against_brute_force(spark):
    """Every step again with plain loops: terms, document frequencies, lift, all cosines, votes, curve, evidence."""
    import random
    import zlib

    import numpy as np

    random.seed(8)
    common, rare = [f"c{chr(97 + i)}" for i in range(20)], [f"r{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    texts, marks = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = random.choices(common, k=random.randrange(60)) + random.choices(rare, k=8) + (random.choices(["idiot", "scum", "trash"], k=2) if toxic and i % 12 else [])
        random.shuffle(words)
        texts.append((i, " ".join(words)))
        if i % 3:
            marks.append((i, None, int(toxic)))
    texts += [(500 + i, t) for i, (_, t) in enumerate(TEXTS)] + [(700, texts[1][1]), (701, "Idiot!"), (702, "zzzz")]
    marks += [(700, None, 0)]
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(documents(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}

    terms = {i: Counter(w.lower() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", t or "")) for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in texts}
    examples = [(i, y) for i, _, y in marks if not held[i]]
    df = Counter(t for c in terms.values() for t in c)
    by_text = dict(texts)

    def alike(i):
        w = (by_text[i] or "").encode().lower()
        s = toxicity.shingle_set(w, toxicity.WordHashes())
        return int(s[0]) if len(s) else 0

    once = {(alike(i), y): (i, y) for i, y in sorted(examples)}.values()
    seen = (Counter(), Counter())
    for i, y in once:
        seen[y].update(terms[i].keys())
    share = sum(y for _, y in once) / len(once)
    vocabulary = {t for i, _ in examples for t in terms[i]}
    weight = {t: (np.log((1 + len(texts)) / (1 + df[t])) + 1) * ((seen[1][t] + toxicity.PRIOR) / ((seen[0][t] + seen[1][t]) * share + toxicity.PRIOR)) ** 2 for t in vocabulary}

    def vector(i):
        v = {t: (1 + np.log(n)) * weight[t] for t, n in terms[i].items() if t in vocabulary}
        length = sum(x * x for x in v.values()) ** 0.5
        return {t: x / length for t, x in v.items()}

    vectors = {i: vector(i) for i in terms}

    def features(i, without=None):
        v = vectors[i]
        found = [(sum(x * vectors[j].get(t, 0) for t, x in v.items()), j, y) for j, y in examples if j != without]
        best = sorted((f for f in found if f[0] > 0), reverse=True)[: toxicity.K]
        return best, [sum(c * y for c, _, y in best) / sum(c for c, _, _ in best)] if best else None

    left = [(features(i, i)[1], y) for i, y in examples]
    b = toxicity.curve(np.array([x for x, _ in left if x]), np.array([y for x, y in left if x], float))
    for i, _ in texts:
        best, x = features(i)
        want = sum(y for _, y in examples) / len(examples) if x is None else 1 / (1 + np.exp(-(b[0] + np.dot(b[1:], x))))
        assert abs(got[i]["score"] - want) < 2e-3, i
        assert got[i]["held_out"] == held[i] and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        assert np.allclose([e["cosine"] for e in got[i]["evidence"]], [c for c, _, _ in best[: toxicity.EVIDENCE]], atol=1e-5)
        assert all(dict(examples)[e["doc_id"]] == e["label"] for e in got[i]["evidence"])


def test_near_duplicates_against_all_pairs(spark):
    import random

    random.seed(9)
    word = lambda: "".join(random.choice("abcdef") for _ in range(4))
    base = [word() for _ in range(60)]
    texts = []
    for i in range(150):  # a group of copies with different numbers of edits: chains, and members out of reach
        w = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3, 5, 8])):
            w[random.randrange(60)] = word()
        texts.append((1000 + i, " ".join(w)))
    texts += [(500 + i, " ".join(word() for _ in range(random.randrange(12)))) for i in range(60)] + TEXTS

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    nodes = [(i, shingles(t)) for i, t in texts if i is not None]
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, sa in nodes:
        for b, sb in nodes:
            if a < b and sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = Counter((i, len(shingles(t)), None if i is None else find(i)) for i, t in texts)
    got = minhash.near_duplicates(documents(spark, texts)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_classifiers_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    q = quality_model.quality_scores(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.97
    t = toxicity.toxicity_scores(d, y).join(y, "doc_id").where("held_out").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.97


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_pieces", "ids"]
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_model.quality_scores(d, y).where("predicted = 1").collect()}
    unlike = {r["doc_id"] for r in minhash.near_duplicates(d.where(d.doc_id.isin(list(good)))).where("kept").collect()}
    got = {r["doc_id"] for r in out.collect()}
    assert got and got <= unlike <= good


def test_pipeline_stages_against_brute_force(spark):
    """Every stage's rows from its own input, recomputed plainly: verdicts, linked groups, cut bytes, words taken, the library's ids."""
    import corpus_pipeline
    from kinetrace.storage import keep

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r["doc_id"] for r in quality_model.quality_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.7").collect()}
    tables = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(keep(stage(spark, tables[-1], sf), f"test-{number}"))
    rows = [t.collect() for t in tables]
    assert {r["doc_id"] for r in rows[1]} == good and set(rows[1]) <= set(rows[0])

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    nodes = {r["doc_id"]: shingles(r["text"]) for r in rows[1]}
    least = {i: i for i in nodes}
    changed = True
    while changed:
        changed = False
        for a, sa in nodes.items():
            for b, sb in nodes.items():
                if least[b] < least[a] and sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                    least[a], changed = least[b], True
    assert set(rows[2]) == {r for r in rows[1] if least[r["doc_id"]] == r["doc_id"]}

    n, data = suffix_dedup.LENGTH, {r["doc_id"]: (r["text"] or "").encode() for r in rows[2]}
    seen = Counter(b[i : i + n] for b in data.values() for i in range(len(b) - n + 1))
    want = {}
    for doc, b in data.items():
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        parts, at = [], 0
        for i in range(len(b) + 1):
            if i == len(b) or gone[i]:
                parts.append(b[at:i].decode("utf-8", "ignore"))
                at = i + 1
        want[doc] = "".join(parts)
    assert {r["doc_id"]: r["text"] for r in rows[3]} == want and all(r["n_chars"] == len(r["text"]) for r in rows[3])

    taken = {r["doc_id"]: r["taken"] for r in mixing.mixture(tables[3]).collect()}
    mixed = Counter()
    for r in rows[4]:
        mixed[r["doc_id"]] += len((r["text"] or "").encode().split())
        assert set((r["text"] or "").split()) <= set((want[r["doc_id"]] or "").split())
    assert {k: v for k, v in mixed.items() if v} == {k: v for k, v in taken.items() if v}

    sp = library()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows[5]) == Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in rows[4])


def test_executors_need_no_copy_of_the_package(tmp_path):
    """All queries from another folder, where only the driver finds the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").getOrCreate()
for name, query in entry.queries().items():
    if name in ("pipeline", "license_windows") or name.startswith("op"):
        print("rows", name, query(spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("rows") == 15


def test_toxicity_leaves_out_every_repeat_of_a_row():
    import numpy as np

    vectors = [(np.array([0, 1]), np.array([1, 2])), (np.array([0, 1]), np.array([1, 2])), (np.array([1, 2]), np.array([1, 1]))]
    index, order = toxicity.Index.built(np.arange(3, dtype=np.uint64), np.ones(3), vectors, np.array([1.0, 1.0, 0.0]), np.array([5, 5, 6]))
    twins = tuple(int(np.flatnonzero(order == i)[0]) for i in (0, 1))
    hashes, times = np.array([0, 1], np.uint64), np.array([1, 2])
    assert len(index.features(hashes, times)[1]) == 3
    vote, place, _ = index.features(hashes, times, without=twins)
    assert vote.tolist() == [0.0] and order[place].tolist() == [2]
