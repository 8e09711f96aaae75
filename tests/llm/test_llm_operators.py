"""Each operator against brute force on a small table of odd cases, and on an empty one."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import ROWS
from holdfast.llm import dedup, disclosure, extraction, forest, licences, machine, packing, pieces, simhash, urlrules
from holdfast.llm.queries import OP4_SQL, PIECES, RULES, WORDS
from plain import brute_components, brute_fingerprint

BLANK = re.compile(r"[\x20\x09-\x0D]")


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    cut = packing.token_pieces(docs, WORDS, 2)
    packed = packing.pack(cut).collect()
    want = sorted(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t, _ in ROWS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    got = []
    for own in by_doc.values():  # id 9 comes twice with one piece each
        got += [bytes(r.ids) for r in own] if len(own) == 2 and own[0].start == own[1].start else \
            [b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.start))]
    assert sorted(got) == want
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack(packing.token_pieces(none, WORDS, 2)).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(0)
    histogram = {int(c): int(n) for c, n in zip(range(1, 65), rng.integers(0, 60, 64)) if n}
    layout = packing.plan(histogram, 64)
    fill = defaultdict(int)
    for c, n in histogram.items():
        rows = layout[c]
        assert rows[0, 0] == 0 and rows[-1, 1] == n and (rows[1:, 0] == rows[:-1, 1]).all()
        for first, after, each, sequence in rows:
            for k in range(after - first):
                fill[sequence + k // each] += c
    assert max(fill.values()) <= 64 and sum(fill.values()) / 64 / len(fill) > 0.97


def test_pieces(docs, none):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    rows = docs.where(~F.col("text").contains("▁") | F.col("text").isNull()).select("text", pieces.encode(PIECES)(F.coalesce("text", F.lit(""))).alias("ids"))
    for r in rows.withColumn("back", pieces.decode(PIECES)("ids")).collect():
        assert r.ids == library.encode(r.text or "") and r.back == library.decode(r.ids)
    assert none.select(pieces.encode(PIECES)("text")).count() == 0


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].fingerprint == by_id[3].fingerprint == by_id[4].fingerprint == 0 and by_id[4].component_id == 2
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 70, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 70).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    want = np.bitwise_count(prints[:, None] ^ prints[None, :])
    far = simhash.distances(prints, radius)
    own = ~np.eye(len(prints), dtype=bool)
    if far is None:
        assert not (want[own] <= radius).any()
    else:
        assert ((far != simhash.FAR) == ((want <= radius) & own)).all()


def test_simhash_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = ["", None, " \t", "one", "ONE", "Two  words", "a b c a b c a b c", "é É\u00a0x\x0by"]
    for _ in range(12):
        words = [f"w{k}" for k in rng.integers(0, 400, 120)]
        texts.append(" ".join(words))
        for edits in (1, 1, 2, 4):
            for at in rng.integers(0, 120, edits):
                words[at] = "changed"
            texts.append("\n".join(words))
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(1000, "one")]
    prints = [brute_fingerprint(t or "", 3) for _, t in rows]
    roots = brute_components([i for i, _ in rows], prints, 3)
    want = sorted((i, f, r) for (i, _), f, r in zip(rows, prints, roots))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in simhash.near_duplicates(table).collect())
    assert got == want
    assert 1 < len(set(roots)) < len(rows) - 10  # some are joined, not all


def test_exact_duplicates(docs, none):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), i))
    got = defaultdict(list)
    for r in dedup.exact_duplicates(docs, files_per_trigger=1).collect():
        got[r.text_sha256].append(r)
    for text, own in groups.items():
        rows = got[hashlib.sha256(text.encode()).hexdigest()]
        assert len(rows) == len(own) and {r.keep_id for r in rows} == {min(own)[1]} and sum(r.kept for r in rows) == 1
    assert dedup.exact_duplicates(none).count() == 0


def test_disclosure(docs, none):
    got = {r.doc_id: r for r in disclosure.find(docs).collect()}
    assert [s.value for s in got[6].base] == ["a@b.com", "b@c.org", "_d@e.net", "+1 (706) 555-3138"]
    assert [s.kind for s in got[7].base] == ["card", "ip", "ip"] and not got[2].spans
    clean = disclosure.find(docs).join(docs, "doc_id").where("doc_id = 6").select(
        disclosure.sanitised(F.col("text"), F.col("spans")).alias("t")).first().t
    assert clean == "write to [EMAIL] or [EMAIL][EMAIL], [PHONE] now"
    assert disclosure.find(none).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"the boss Zebulon has mail z@corp.com and number {i}") for i in range(5)] + [(9 + i, "the boss is away") for i in range(50)]
    spans = {r.doc_id: [s.value for s in r.spans if s.kind == "term"] for r in disclosure.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "zebulon" in spans[0] and "boss" not in spans[0] and not spans[9]


def test_disclosing_terms_against_brute_force(spark):
    """Terms far from the entity, short ones, in texts without it, and repeated rows."""
    rng = np.random.default_rng(3)
    common = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    texts = ["", None, "İzmir ÉCOLE z@corp.com"]
    for k in range(90):
        fill = list(rng.choice(common, 60))
        if k % 9 == 0:
            fill = ["Bo", "Quarzenthal", *fill, *fill, "mail", "z@corp.com"]
        elif k % 9 == 1:
            fill = ["call +1 (706) 555-3138", *fill, "Li", "wang@corp.com"]
        elif k % 30 == 2:
            fill += ["Bo", "çorp", "élan@corp.com"]
        texts += [" ".join(fill)] * (1 + k % 2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

    def outside(text):
        return email.sub(lambda m: " " * len(m[0]), text)

    def terms_of(text):
        return [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", outside(text))]

    def entities_of(text):
        return {m.lower() for m in email.findall(text)} | set(re.findall(r"\+1 \(706\) 555-3138", text))

    own = [({t for t, _, _ in terms_of(x or "")}, entities_of(x or "")) for x in texts]
    n, told = len(texts), set()
    for e in set().union(*(e for _, e in own)):
        n_c = sum(e in found for _, found in own)
        for t in set().union(*(t for t, _ in own)):
            n_ct, n_t = sum(t in a and e in b for a, b in own), sum(t in a for a, _ in own)
            if n_ct >= 3 and np.log(n * n_ct / (n_c * n_t)) >= 0.9 * np.log(n / n_c):
                told.add(t)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [(s.value, s.start, s.end) for s in r.spans if s.kind == "term"] for r in disclosure.find(rows).collect()}
    assert {"quarzenthal", "mail", "li", "call", "bo"} <= told and "wang" not in told and not told.intersection(common)
    assert got == {k: [x for x in terms_of(text or "") if x[0] in told] for k, text in enumerate(texts)}


PAGE = ("<html><head><title>T &amp; t</title></head><body><nav><ul><li>Home</ul></nav><div class='x'>Shared line</div><p>Text {0} &lt;of&gt;"
        " the<br>page</p><p>More {0}x</p><form>Sign <b>up</b></form><!-- {0} --><footer>End</footer></body></html>")


def test_extraction(spark):
    rows = [(i, "http://a.b/x", PAGE.format(f"no{i}")) for i in range(10)] + [(20, None, None), (21, "", ""), (22, "http://z.z/", "<p>a<p>b <!-- open")]
    got = {r.page_id: r.text for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].endswith("Text no3 <of> the page\n\nMore no3x") and "Home" not in got[3] and "Sign" not in got[3] and "End" not in got[3]
    assert got[20] == got[21] == "" and got[22] == "a\n\nb"


def test_template_of_most_pages(spark):
    """Blocks that one page lacks, and those of one section's pages, on a host with empty, cut and other pages."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(24):
        text = " ".join(f"w{n}" for n in rng.integers(0, 10_000, 30))
        part = "<div class='a b'><b>Read</b> all the daily stories <i>here</i></div>" if k % 3 else ""
        line = "<p>Printed for our many readers</p>" if k % 4 else ""
        page = f"<body><div>Town paper since long ago</div>{line}<div class='t'><p>{text}</p><p>{k} ends</p></div>{part}<div class='z'>All rights kept</div></body>"
        rows.append((k, "http://a.b/x", page if k != 5 else page[:page.index("<p>")]))
        want[k] = f"{text}\n\n{k} ends" if k != 5 else ""
    rows += [(30, "http://a.b/y", None), (31, "http://a.b/y", " \n"), (32, "http://a.b/z", "<p>another page altogether")]
    want |= {30: "", 31: "", 32: "another page altogether"}
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in extraction.extract(table).collect()} == want


def test_hosts_in_parts(spark):
    """A host cut into parts has the template of the whole, and the counts are those of plain Python."""
    pages = [("a", PAGE.format(f"no{k}")) for k in range(400)] + [("a", PAGE.format("").replace("Shared", "Other"))] * 60
    table = spark.createDataFrame(pages, "host string, html string").repartition(3)
    whole, cut = (sorted((r.root, sorted(map(str, r.inner or []))) for r in extraction.templates(table, pages_in_part=n).collect()) for n in (1000, 150))
    assert whole == cut and len(whole) == 1 and len(whole[0][0]) > 10
    items = extraction.walk(pages[3][1])
    counts, first = defaultdict(int), {}
    for place, token in enumerate(extraction.tokens(items)):
        counts[token] += 1
        first.setdefault(token, place)
    found = extraction._counted(items)
    assert {(p, w): (n, found[p][1][w]) for p, (own, _) in found.items() for w, n in own.items()} == {t: (n, first[t]) for t, n in counts.items()}


def test_url_rules(spark):
    rows = [(1, "http://X.Example.net/en/a?q"), (2, "http://example.net/fr"), (3, "http://net"), (4, None), (5, "nothing"), (6, "ftp://a.org/fr/#x"),
            (7, "http://planet/"), (8, "http://www.example.com/de/x"), (9, "http://example.netx/en/")]
    urls = spark.createDataFrame(rows, "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(urls, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"),
                   6: ("org/fr/", "allow"), 7: (None, "allow"), 8: ("example.com/de/", "block"), 9: (None, "allow")}
    assert {r.verdict for r in urlrules.judge(urls, rules.where("false")).collect()} == {"allow"} and "pages" in OP4_SQL


def test_licences(docs, none):
    found = licences.scan(docs).collect()
    assert [(r.doc_id, r.licence, r.start, r.end) for r in found] == [(11, "MIT", 0, 30)]
    assert licences.scan(none).count() == 0


def test_forest(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3000, 8))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in forest.nearest(table, F.col("vec_id") % 100 == 0, at_least=0).orderBy("rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = np.linalg.norm(points - points[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(found))
    assert len(got) == 30 and hits >= 0.9 * 300
    assert forest.nearest(table.where("false"), F.lit(True)).count() == 0


def test_forest_in_small_blocks(spark):
    """All leaves taken, in blocks of few rows and queries: brute force, with ids that repeat and lengths beyond squares."""
    rng = np.random.default_rng(2)
    rows = [(k % 400, (rng.normal(size=4) * (1e200 if k % 40 == 7 else 1.0)).tolist()) for k in range(1200)] + [(900 + k, [1.0, 2.0, 3.0, 4.0]) for k in range(90)]
    want = defaultdict(list)
    with np.errstate(over="ignore"):
        for q, x in rows:
            if q % 100 == 0:
                far = {}
                for i, y in rows:
                    if i != q:
                        far[i] = min(far.get(i, np.inf), float(np.sqrt(((np.array(y) - np.array(x)) ** 2).sum())))
                want[q].append(far)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = forest.nearest(table, F.col("vec_id") % 100 == 0, share=1.0, leaf=64, block=50, asked=3)
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    for q, fars in want.items():
        nearest = {i: min(far[i] for far in fars) for i in fars[0]}
        assert got[q] == sorted((d, i) for i, d in nearest.items())[:10]
    assert len(got) == len(want) == 5


def test_packed_blocks_are_bounded():
    """What a task holds at a time: blocks of at most so many rows, with every row in one."""
    batches = [pa.record_batch({"a": list(range(n))}) for n in (0, 3, 25, 1, 10, 2)]
    blocks = [pa.ipc.open_stream(b.column(0)[0].as_buffer()).read_all()["a"].to_pylist() for b in forest._packed(iter(batches), 10)]
    assert max(map(len, blocks)) <= 10 and [x for b in blocks for x in b] == [x for b in batches for x in b["a"].to_pylist()]
    assert list(forest._packed(iter([]), 10)) == []


def test_quality(spark, docs, none):
    rows = [(i, f"plain words of text number {i} and so on" if i % 2 else f"SPAM!! {i} SPAM!! SPAM!!", None, 30) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = machine.scored(table, labels).select("row.doc_id", "held_out", "score").collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    odd = machine.scored(docs, labels.where("false")).collect()
    assert len(odd) == len(ROWS) and {round(r.score, 6) for r in odd} == {0.5} and machine.scored(none, labels).count() == 0


def test_vocabulary_paths():
    assert public_tokenizers.path("word_bpe_49k.json") == WORDS


def test_pieces_agendas():
    """Chunks short and long, with characters outside the vocabulary, against the library."""
    vocabulary, rng = pieces.Vocabulary(PIECES), np.random.default_rng(5)
    letters = list("etaoinshr.,é日\U0001F600")
    texts = ["".join(rng.choice(letters + [" ", "\n", "▁"], n)) for n in rng.integers(0, 200, 300)]
    texts += ["".join(rng.choice(letters, n)) for n in rng.integers(60, 300, 60)] + ["", " ", "▁", "a ", "  a", "x" * 65]
    for text in texts:
        cut = pieces.chunks_of(text) if text else []
        found = np.frombuffer(b"".join(vocabulary.merge(cut)), np.int32).tolist()
        assert found == vocabulary.library.encode(text), text


def test_every_decoded_row_is_checked(spark):
    """Two bytes that begin a character and don't end it: the library gives another text, which any row must show."""
    vocabulary = pieces.Vocabulary(PIECES)
    plain, cut = vocabulary.library.encode("some words"), vocabulary.bytes[[0xE3, 0x81]].tolist()
    rows = spark.createDataFrame([(k, plain) for k in range(3)], "n int, ids array<int>")
    texts = rows.select(pieces.decode(PIECES)("ids").alias("t"))
    assert [r.t for r in texts.collect()] == ["some words"] * 3
    odd = rows.union(spark.createDataFrame([(3, cut)], "n int, ids array<int>")).coalesce(1)
    with pytest.raises(Exception, match="differs from the library"):
        odd.select(pieces.decode(PIECES)("ids").alias("t")).collect()
