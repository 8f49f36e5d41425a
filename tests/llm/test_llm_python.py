"""Operators that run in Arrow batches, against plain Python versions."""

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from barometry.llm import bpe, language, licenses, quality

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS)


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab'stdrvelm \t\n 　é1٣²!.-_😀<|>", max_size=40), max_size=6))
def test_bpe_equals_library(texts):
    assert ids(texts) == [LIBRARY.encode_ordinary(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60).filter(lambda t: t.isprintable() or t.isspace()))
def test_bpe_any_text(text):
    assert b"".join(LIBRARY.decode_single_token_bytes(i) for i in ids([text])[0]) == text.encode()


def test_bpe_long_pre_tokens_and_blocks(monkeypatch):
    rng = random.Random(1)
    texts = ["a" * 3000, "".join(rng.choice("abth") for _ in range(5000)), "ab" * 2000, " " * 900 + "x", "<|endoftext|>", None, ""]
    assert ids(texts) == [LIBRARY.encode_ordinary(t or "") for t in texts]
    text = " ".join(rng.choice(["the", "and ", " other", "\n\nline", "don't"]) for _ in range(3000))
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    assert "".join(bpe.pieces(text, 100)) == text
    assert ids([text, "x", text]) == [LIBRARY.encode_ordinary(t) for t in (text, "x", text)]


def test_bpe_round_trip(spark, small_docs, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for docs in (small_docs, odd_docs, no_docs):
        out = bpe.decode(bpe.encode(docs, path), path)
        rows = out.withColumn("numbers", bpe.id_array(out["ids"])).select("text", "n_tokens", "decoded", "numbers").collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert bytes(r.decoded) == (r.text or "").encode()
            assert r.n_tokens == len(r.numbers)
            if len(r.text or "") < 5000:
                assert r.numbers == LIBRARY.encode_ordinary(r.text or "")


def test_bpe_one_pass(spark, small_docs, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(bpe, "DECODE_IDS", 7)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for docs in (small_docs, odd_docs, no_docs):
        out = bpe.round_trip(docs, path, ids="_ids").collect()
        assert len(out) == docs.count() and all(r.round_trip for r in out)
        assert Counter((r.doc_id, bytes(r._ids)) for r in out) == Counter(
            (r.doc_id, bytes(r.ids)) for r in bpe.encode(docs, path).collect())


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_base(text):
    words, found = plain_words(text), []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def test_license_base(small_docs, odd_docs, no_docs):
    for docs in (small_docs, odd_docs, no_docs):
        rows = licenses.license_scan(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(r.text or "")
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_base_of_random_lists():
    """Lists over the words of phrases and templates: parts of phrases, and phrases in pieces of templates."""
    rng, a = random.Random(11), automaton()
    phrase_words = sorted({w for p in licenses.BASE_PHRASES for w in plain_words(p)}) + ["lesser", "affero", "other"]
    pool = phrase_words * 6 + [w for t in licenses.TEMPLATES.values() for w in plain_words(t)]
    texts = ["General Public License", "GNU Lesser General Public License", "the GNU Affero General Public License", "license", "public license gnu general"]
    texts += [" ".join(rng.choice(phrase_words if k % 2 else pool) for _ in range(rng.randrange(1, 14))) for k in range(20_000)]
    for text in texts:
        assert licenses.scan_text(a, text.encode())[:5] == plain_base(text), text


def automaton():
    return licenses.Automaton(licenses.TEMPLATES, licenses.BASE_PHRASES)


@functools.cache
def template_parts():
    templates = [plain_words(t) for t in licenses.TEMPLATES.values()] + [plain_words(p) for p in licenses.BASE_PHRASES]
    return {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


def plain_matches(words):
    """Longest template suffix that ends at every word, where it cannot go on."""
    parts, longest = template_parts(), []
    for end in range(1, len(words) + 1):
        n = longest[-1] + 1 if longest else 1
        while n and tuple(words[end - n:end]) not in parts:
            n -= 1
        longest.append(n)
    return [(end + 1 - n, n) for end, n in enumerate(longest)
            if n >= licenses.MIN_MATCH and (end + 1 == len(longest) or longest[end + 1] != n + 1)]


def test_matching_statistics():
    rng, a = random.Random(3), automaton()
    pool = [w for t in licenses.TEMPLATES.values() for w in plain_words(t)] + ["other", "words"]
    for k in range(60):
        words = []
        while len(words) < 120:
            t = plain_words(rng.choice(list(licenses.TEMPLATES.values())))
            i = rng.randrange(len(t))
            words += t[i:i + rng.randrange(1, 12)] if rng.random() < 0.7 else [rng.choice(pool)]
        _, matches = a.scan([w.encode() for w in words])
        assert [(s, n) for s, n, _ in matches] == plain_matches(words)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_license_template_with_edits(name):
    words = licenses.TEMPLATES[name].split()
    text = "Some code. " + " ".join(w if i % 25 != 20 else "EDITED" for i, w in enumerate(words)) + " More code."
    labels = licenses.scan_text(automaton(), text.encode())[5].split(",")
    assert name in labels
    assert licenses.scan_text(automaton(), b"the software is here, with no license at all; copy and use it.")[5] == ""


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_quality_base(small_docs, odd_docs, no_docs):
    for docs in (small_docs, odd_docs, no_docs):
        rows = quality.quality(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(r.text or "")
            assert not (r.kept and r.base_failed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality.repeated_words(words) == plain_quality(" ".join(w.decode() for w in words))[4]


def test_quality_lines():
    good = "This is a plain sentence of ordinary prose.\n" * 1
    text = good + "Home | About | News | Contact\nWe use cookies, see our privacy policy for more.\n***$$$ ###&&&\nAnother sentence ends this text."
    out = dict(zip(quality.OUTPUTS, quality.judge(text.encode())))
    assert out["n_failed_lines"] == 3 and out["cleaned"] == good + "Another sentence ends this text."


def test_quality_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1 and not r.base_failed], [r for r in rows if r.quality == 0]
    assert all(r.kept for r in good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.language_id(docs, host="source", label="lang").collect()
    right = [r.language == r.lang for r in found]
    assert len(found) == docs.count() and sum(right) > 0.97 * len(right)
    assert sum(r.language_kept for r in found) > 0.99 * len(found)
    # Fitted on one half, measured on the other.
    model = language.train(docs.where("doc_id % 2 = 0"), "text", "lang", language.LANGUAGES)
    rest = language.score(docs.where("doc_id % 2 = 1"), model, "text").collect()
    assert sum(language.LANGUAGES[int(np.argmax(r._loglik))] == r.lang for r in rest) > 0.97 * len(rest)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_foreign_and_noise_texts_go(spark, size):
    """Rejected whatever the size of the fit; clean texts stay."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text", "lang", "source")
    letters = "abcdefghijklmnopqrstuvwxyz"
    strange = ["これは日本語の文章です。言語を判定するためのものです。" * 4, "Это русский текст, который не должен остаться в корпусе. " * 4,
               "Αυτό είναι ένα ελληνικό κείμενο για δοκιμή. " * 4, "这是一个用于测试的中文文本。" * 8,
               " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 10))) for _ in range(120)),
               "".join(chr(rng.randrange(33, 127)) for _ in range(600))]
    extra = spark.createDataFrame([(-1 - i, t, lang, "src0") for i, t in enumerate(strange) for lang in ("en", "de", None)], docs.schema)
    rows = language.language_id(docs.unionByName(extra), declared="lang", host="source").collect()
    clean = [r for r in rows if r.doc_id >= 0]
    assert not [r.text[:30] for r in rows if r.doc_id < 0 and r.language_kept]
    assert sum(r.language_kept for r in clean) >= 0.99 * len(clean)


def test_language_scores_are_those_of_plain_python(spark):
    """Likelihood, unseen trigrams and fused posterior of a few texts, worked out in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    model = language.train(docs, "text", "lang", language.LANGUAGES)
    rows = language.score(docs.where("doc_id < 12"), model, "text").collect()
    counts, held = [Counter() for _ in language.LANGUAGES], [Counter() for _ in language.LANGUAGES]
    seen = set()
    for r in docs.collect():
        data = (r.text or "").encode().lower()
        if r.lang in language.LANGUAGES and (r.lang, r.text) not in seen:
            seen.add((r.lang, r.text))
            own = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(data) - 2)]
            counts[language.LANGUAGES.index(r.lang)].update(own)
            held[language.LANGUAGES.index(r.lang)].update(set(own))
    for r in rows:
        data = (r.text or "").encode().lower()
        buckets = [((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(data) - 2)]
        for k, c in enumerate(counts):
            total = sum(c.values()) + 0.5 * language.BUCKETS
            want = sum(np.log((c[b] + 0.5) / total) for b in buckets)
            assert r._loglik[k] == pytest.approx(want, abs=1e-6 * max(1, len(buckets)))
            assert r._unseen[k] == sum(held[k][b] < 2 for b in buckets)


def test_language_fusion(spark, odd_docs, no_docs):
    """The declared language and the host decide where the text says nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang", "concat('h-', lang, '.example') as host")
    extra = spark.createDataFrame([(-1, "a", "fr", None), (-2, "a", None, "h-de.example"), (-3, None, "fr", None), (-4, " \n", None, None)], docs.schema)
    rows = {r.doc_id: r for r in language.language_id(docs.unionByName(extra), declared="lang", host="host").collect()}
    assert rows[-1].language == "fr" and rows[-2].language == "de"
    assert rows[-1].language_kept and not rows[-3].language_kept and not rows[-4].language_kept
    odd = language.language_id(odd_docs, declared="lang", host="source").collect()
    assert len(odd) == odd_docs.count()
    narrow = language.language_id(odd_docs, declared="lang", host="source", keep_text=False).collect()
    assert Counter((r.doc_id, r.language, r.language_kept) for r in odd) == Counter((r.doc_id, r.language, r.language_kept) for r in narrow)
    assert language.language_id(no_docs, declared="lang", host="source").count() == 0


def test_language_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = pages.withColumn("declared", language.declared_in(pages["html"]))
    rows = language.language_id(made, "html", declared="declared", url="url").collect()
    assert sum(r.language == r.declared for r in rows) > 0.9 * len(rows)
    host = spark.createDataFrame([("https://u:p@WWW.Example.co.uk:80/x?y",), ("nonsense",), (None,)], "url string")
    got = host.select(language.host_of(host["url"]).alias("h"), language.suffix_of(language.host_of(host["url"])).alias("s")).collect()
    assert [tuple(r) for r in got] == [("www.example.co.uk", "uk"), ("", None), (None, None)]


def test_digest_of_ids():
    text = "The digest is that of the packed numbers."
    packed = ENCODER.encode([text])[0]
    assert hashlib.sha256(packed).hexdigest() == hashlib.sha256(np.array(LIBRARY.encode_ordinary(text), "<u4").tobytes()).hexdigest()
