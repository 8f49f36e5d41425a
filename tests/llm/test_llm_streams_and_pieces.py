"""Pieces, filter audit and fill-in-the-middle, against the usual library and plain Python versions."""

import hashlib
import random
import re
import tempfile
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barometry.llm import audit, infill, pieces
from barometry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
VOCABULARY = pieces.read_model(MODEL)
SEGMENTER = pieces.Segmenter(VOCABULARY)


# -- op11 ----------------------------------------------------------------------------------------------

def library_ids(text):
    return LIBRARY.encode(text or "", add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abthe ing  ▁\n\t<s>/0xAé日😀\x00ﬁ-", max_size=60), max_size=6))
def test_pieces_equal_library(texts):
    assert [x.tolist() for x in SEGMENTER.encode(texts)] == [library_ids(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31_999), st.sampled_from([1, 2, 259, 28705])), max_size=12))
def test_any_ids_decode_like_library(ids):
    assert pieces.decoded(VOCABULARY, ids) == LIBRARY.decode(ids)


def test_long_words_blocks_and_a_small_table(monkeypatch):
    rng = random.Random(4)
    texts = ["x" * 3000, "".join(rng.choice("abthing") for _ in range(4000)), " " * 500, "▁" * 70, "a " * 900, None, "",
             " ".join("".join(rng.choice("aeinst") for _ in range(rng.randrange(1, 40))) for _ in range(2000))]
    want = [library_ids(t) for t in texts]
    assert [x.tolist() for x in pieces.Segmenter(VOCABULARY).encode(texts)] == want
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 50)
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 20)
    assert [x.tolist() for x in pieces.Segmenter(VOCABULARY).encode(texts)] == want
    assert "".join(pieces.parts_of(texts[-1])) == "▁" + texts[-1].replace(" ", "▁") and len(list(pieces.parts_of(texts[-1]))) > 100


def test_pieces_query(spark, odd_docs, no_docs):
    rows = QUERIES["op11_sentencepiece"](spark, SF).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        ids = library_ids(docs[r.doc_id])
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids)))
    made = pieces.decode(pieces.encode(odd_docs, MODEL), MODEL).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in made) == Counter(
        (r.doc_id, tuple(library_ids(r.text)), LIBRARY.decode(library_ids(r.text))) for r in odd_docs.collect())
    assert pieces.encode(no_docs, MODEL).count() == 0


# -- op12 ----------------------------------------------------------------------------------------------

def plain_audit(docs, labels):
    """Every filter of every order, document by document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = [], defaultdict(lambda: [0] * 7)
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        mask = "".join(x for x, bad in zip("ABCDE", (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            re.search(r"[#$%&*|]", t), i is not None and least[t] < i)) if bad)
        fails.append((part or "", set(mask), i in good, i in toxic))
    shapley = Counter()
    for part, mask, g, x in fails:
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                hit = f in mask
                row[1] += hit and not gone
                row[2] += hit and gone
                row[3] += mask == {f}
                row[4] += hit and not gone and g
                row[5] += hit and not gone and x
                shapley[part, f] += hit and not gone
                gone = gone or hit
                row[0] += not gone
    for (part, order, step), row in out.items():
        row[6] = shapley[part, order[step - 1]]
    return {k: tuple(map(int, v)) for k, v in out.items()}


def as_rows(report):
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in report.collect()}


@pytest.fixture(scope="module")
def audit_docs():
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["one", "Two", "three", "w%d" % rng.randrange(200), "#x", "FOUR"]) for _ in range(rng.choice([3, 30, 60, 90])))
             for _ in range(25)] + [None, "", "same text", " "]
    docs = [(rng.choice([None, *range(-5, 120)]), rng.choice(texts), rng.choice([None, "", "a", "b", "c.example"])) for _ in range(240)]
    docs += [(9, "same text", "a"), (9, "same text", "a"), (9, "same text", "b"), (-50, "same text", "c.example")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(-5, 100)] + [(9, 1, 0), (9, 0, 1), (None, 1, 1)]
    return docs, labels


def test_audit_retracts_over_batches(spark, audit_docs):
    """Smaller ids arrive last: earlier rows turn into copies. A later run goes on from the checkpoint."""
    docs, labels = audit_docs
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ordered = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))

    def write(rows):
        spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr(
            "*", "1 as mask", "'x' as part", "2 as h1", "true as good").coalesce(1).write.mode("append").parquet(f"{folder}/docs")

    step = len(ordered) // 5
    cut = [ordered[i:i + step] for i in range(0, len(ordered), step)]
    for part in cut[:-2]:
        write(part)
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{folder}/docs").schema).option(
        "maxFilesPerTrigger", 1).parquet(f"{folder}/docs")
    first = as_rows(audit.filter_audit(stream(), marks, f"{folder}/audit"))
    assert first == plain_audit([r for part in cut[:-2] for r in part], labels)
    for part in cut[-2:]:
        write(part)
    report = audit.filter_audit(stream(), marks, f"{folder}/audit")
    assert as_rows(report) == plain_audit(docs, labels)
    assert len(as_rows(report)) == 600 * len({p or "" for _, _, p in docs})
    # The state holds each text's smallest id, and nothing older.
    last = max(int(b) for b in re.findall(r"batch=(\d+)", " ".join(spark.read.parquet(f"{folder}/audit/counters").inputFiles())))
    kept = audit.state(spark, f"{folder}/audit", last).select("h1", "h2", "id").distinct().collect()
    assert sorted(r.id for r in kept) == sorted(min(i for i, t, _ in docs if i is not None and (t or "") == text)
                                                for text in {t or "" for i, t, _ in docs if i is not None})


def test_audit_of_a_retried_batch(spark, audit_docs):
    docs, labels = audit_docs
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    late = F.coalesce(F.col("doc_id"), F.lit(0)) < 40
    for batch_id, rows in [(0, table.where(~late)), (0, table.where(~late)), (1, table.where(late)), (1, table.where(late))]:
        audit.apply_batch(rows, batch_id, folder, marks, "doc_id", "text", "source")
    assert as_rows(audit.report(audit.counters(spark, folder))) == plain_audit(docs, labels)


def test_audit_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, no_docs):
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        docs.coalesce(1).write.parquet(f"{folder}/docs.parquet")
        got = as_rows(audit.filter_audit(audit.file_stream(spark, f"{folder}/docs.parquet"), labels, f"{folder}/audit"))
        assert got == plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [(4, 1, 0), (5, 1, 1)])


# -- op13 ----------------------------------------------------------------------------------------------

def plain_infill(doc_id, text):
    t, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n = len(units)
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("azAZ@[`{ <PSM>\n\x00\x7f\x80é日😀ÿ"), st.characters(exclude_categories=["Cs"])), max_size=70))
def test_units(text):
    units, data = re.findall("[A-Za-z]+|[^A-Za-z]", text), text.encode()
    found = infill.Units(data)
    assert found.count == len(units)
    for k in range(len(units) + 1):
        cut = found.cut(k)
        assert data[:cut].decode() == "".join(units[:k]) and found.chars(cut) == len("".join(units[:k]))


def test_infill(spark, odd_docs, no_docs):
    tricky = spark.createDataFrame([(i, t) for i in range(60) for t in ("<" * 3 + "P" * 2 + "ab c", "has <S> in it", "S>x<", "é😀", "word")],
                                   "doc_id long, text string")
    for docs in (odd_docs, no_docs, tricky, spark.read.parquet(f"{SF}/documents.parquet")):
        made = infill.fill_in_middle(docs).withColumn("_back", infill.restored(F.col("infill"), F.col("form"))).collect()
        assert Counter((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.infill) for r in made) == Counter(
            (r.doc_id, *plain_infill(r.doc_id, r.text)) for r in docs.collect())
        assert all(r._back == (r.text or "") for r in made)
