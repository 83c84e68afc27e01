"""What all operators have to stand: any column names, ids of other types, null, empty, very long and repeated rows, empty tables; and the queries
as they are registered, against their SQL or a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_small_fixtures import WORD, brute_components, brute_lines, brute_quality, n_words

import corpus_pipeline
from deckloom.llm import jaccard, langid, linededup, media, mixing, pieces, quality, queries, sharding, text, urls, warc

SF = "/root/testdata/sf0.001"
#: Names that operators have or had for columns of their own, and names of results.
NAMES = """doc mark _mark _kept _near _id _source _epochs _own _last _copy _found _at _keys _score _lang_pred _letter _bytes lang_pred score rejected shard slot _slot size
n_lines id line place key token node n kind digest payload _digest part component word bits h1 h2 _code posterior kept _deckloom_mark _deckloom_source _deckloom_keys""".split()
LONG = " ".join(f"w{i % 977}" for i in range(30000))
TEXTS = [None, "", "  \n ", LONG, "the cat sat on the mat and looked at the dog again today", "the cat sat on the mat and looked at the dog again today", "one\ntwo\none", "42", "naïve 日本語 🙂 text"]


def clashing(spark, id_type: str):
    """Rows with all those columns, an id of the given type, null and repeated ids."""
    ids = [None, 1, 2, 3, 4, 4, 5, 6, 7]
    rows = [(None if i is None else str(i), t, "s1" if k % 2 else None, *[f"{c}{k}" for c in NAMES]) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    made = spark.createDataFrame(rows, "doc_id string, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES))
    return made.withColumn("doc_id", F.col("doc_id").cast(id_type)).repartition(3)


OPERATORS = {
    "mix_sources": mixing.mix_sources,
    "mixed_documents": mixing.mixed_documents,
    "dedup_lines": linededup.dedup_lines,
    "similar_documents": jaccard.similar_documents,
    "one_of_each": jaccard.one_of_each,
    "judge_urls": lambda d: urls.judge_urls(d, urls.rules_frame(d.sparkSession), url_col="text"),
    "archive_pages": lambda d: warc.archive_pages(d, "doc_id", "text"),
    "identify": lambda d: langid.identify(d, {"en": b"the cat", "fr": b"le chat"}, keep=tuple(c for c in d.columns if c not in ("lang_pred", "score", "rejected"))),
    "accepted_documents": lambda d: langid.accepted_documents(d, {"en": b"the cat sat on the mat", "fr": b"le chat"}),
    "learn": lambda d: langid.identify(d, langid.learn(d, "source")),
    "document_media": media.document_media,
    "interleaved": lambda d: media.interleaved(d, "text", ("doc_id", "_html", "digest") if "_html" in d.columns else ("doc_id", "digest")),
    "encode_texts": pieces.encode_texts,
    "decode_ids": lambda d: pieces.decode_ids(pieces.encode_texts(d), ("doc_id",)),
    "balanced_shards": lambda d: sharding.balanced_shards(d, 3),
    "judge_quality": quality.judge_quality,
}
ROW_FOR_ROW = set(OPERATORS) - {"mixed_documents", "one_of_each", "accepted_documents"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_stand_odd_tables(spark, name):
    for kind in ("bigint", "string"):
        docs = clashing(spark, kind)
        rows = OPERATORS[name](docs).collect()
        if name in ROW_FOR_ROW:
            assert len(rows) == len(TEXTS)
        else:  # columns and their values as given
            assert OPERATORS[name](docs).columns == docs.columns
            assert {r["_own"] for r in rows} <= {f"_own{k}" for k in range(len(TEXTS))}
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_stand_odd_tables(spark, stage):
    docs = clashing(spark, "bigint").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    done = stage[1](spark, docs, SF)
    assert done.count() <= 2 * len(TEXTS)
    if stage[0] != "token_ids":
        assert done.columns == list(corpus_pipeline.COLUMNS)
    assert stage[1](spark, docs.limit(0), SF).count() == 0


# ---- exact identities


def thue_morse(n: int) -> tuple[str, str]:
    one = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 4096, 16384])
def test_complementary_words_differ(spark, n):
    """Words that collide under any polynomial modulo a power of two, in the three operators that know words by a hash."""
    import sentencepiece

    one, two = thue_morse(n)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"{one} b c d e f"), (4, f"{two} b c d e f")], "doc_id long, text string").coalesce(1)
    ids = {r["doc_id"]: r["token_ids"] for r in pieces.encode_texts(docs).collect()}
    assert all(ids[r["doc_id"]] == lib.encode(r["text"]) for r in docs.collect())
    assert {r["component_id"] for r in jaccard.similar_documents(docs).collect()} == {1, 2, 3, 4}
    seven = "p q r s t u v"
    twice = spark.createDataFrame([(1, f"{one} {seven} {two} {seven}"), (2, f"{one} {seven} {one} {seven}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.document_features(twice).collect()}
    assert got == {1: brute_quality(f"{one} {seven} {two} {seven}")[4], 2: 16} and got[1] == 0


@pytest.mark.parametrize("bits", [1, 8])
def test_lines_and_sets_that_share_half_their_hash(spark, monkeypatch, bits):
    """Ids follow the other half too: nothing is lost or merged where nearly all first halves collide."""
    docs = [(i, "\n".join(f"{w} {' '.join(w * k for k in range(2, 9))} {i * (k % 2)}" for k, w in enumerate("abcdef"))) for i in range(8)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = linededup.hash_bits
    monkeypatch.setattr(linededup, "hash_bits", lambda *c, seed=0: F.pmod(whole(*c, seed=seed), F.lit(1 << bits)) if seed == 11 else whole(*c, seed=seed))
    kept = brute_lines(docs)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table).collect()}
    assert got == {i: "\n".join(kept.get((i, t), "").split("\n")) for i, t in docs} and 0 < sum(map(len, got.values())) < sum(len(t) for _, t in docs)
    sets = [(i, " ".join(f"w{i % 9}x{k}" for k in range(12 + i % 2))) for i in range(30)]
    found = jaccard.similar_documents(spark.createDataFrame(sets, "doc_id long, text string").repartition(3), id_bits=bits)
    assert Counter(tuple(r) for r in found.collect()) == Counter(brute_components(sets))


def test_segments_that_share_a_hash(monkeypatch):
    """Ids follow the bytes even where nearly all hashes collide, in one group and between groups."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    whole = pieces.span_hashes
    monkeypatch.setattr(pieces, "span_hashes", lambda *a: whole(*a) % np.uint64(7))
    own = pieces.Encoder(pieces.Vocabulary.load())
    rnd = random.Random(2)
    for _ in range(4):
        texts = [" ".join("".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(1, 30))) for _ in range(12)) for _ in range(20)]
        ids, at = own.encode([t.encode() for t in texts])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.encode(t) for t in texts]


def test_span_hashes_and_equal_spans():
    data = np.frombuffer(b"abcdefgh" * 20 + b"abcdefgX" + b"abcdefgh" * 3, dtype=np.uint8)
    start, stop = np.array([0, 8, 0, 160, 0, 80, 3, 3]), np.array([8, 16, 72, 168, 80, 160, 3, 4])
    h = text.span_hashes(data, start, stop)
    assert h[0] == h[1] and h[0] != h[3] and h[4] == h[5] and len({int(x) for x in h}) == 6
    assert text.equal_spans(data, start, data, start[[1, 0, 0, 0, 5, 4, 6, 7]], stop - start).tolist() == [True, True, True, False, True, True, True, True]


# ---- the registered queries


def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(rows) -> Counter:
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck().execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    found = rounded(tuple(r) for r in got.select(*names).collect())
    assert found == rounded(want) and len(found) > 10


@pytest.fixture(scope="module")
def documents():
    return duck().execute("SELECT doc_id, text, lang, source FROM documents ORDER BY doc_id").fetchall()


def test_op2_query(spark, documents):
    kept = brute_lines([(r[0], r[1]) for r in documents])
    got = {r["doc_id"]: (r["n_kept"], r["kept_crc32"]) for r in queries.op2_line_dedup(spark, SF).collect()}
    assert got == {i: (sum(bool(WORD.search(x)) for x in kept.get((i, t), "").split("\n")), zlib.crc32(kept.get((i, t), "").encode())) for i, t, _, _ in documents}


def test_op3_query_and_recall(spark, documents):
    """Links of every document whose id 20 divides against all others, by brute force on whole sets: none is lost. So all near copies
    that the operator leaves apart are below 80 percent."""
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3_ngram_join(spark, SF).collect()}
    sets = {}
    for i, t, _, _ in documents:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    linked = 0
    for q in (i for i in sets if i % 20 == 0):
        for i, other in sets.items():
            if i != q and other and 100 * len(sets[q] & other) >= 80 * len(sets[q] | other):
                linked += 1
                assert got[i][1] == got[q][1]
    assert Counter((i, *v) for i, v in got.items()) == Counter(brute_components([(r[0], r[1]) for r in documents]))


def test_op6_query_by_held_out_rows(spark, documents):
    """Accuracy on rows that nothing was learned from, by language."""
    rows = {r["doc_id"]: r for r in queries.op6_language(spark, SF).collect()}
    assert len(rows) == len(documents)
    right, total = Counter(), Counter()
    for i, t, lang, _ in documents:
        out = zlib.crc32(str(i).encode()) % 4 == 2
        assert rows[i]["held_out"] == out and 0 <= rows[i]["score"] <= 1
        if not t or not any(c.isalpha() for c in t):
            assert rows[i]["lang_pred"] == "und"
        elif out and lang and n_words(t) >= 5:
            total[lang] += 1
            right[lang] += rows[i]["lang_pred"] == lang
    assert sum(total.values()) >= 20 and sum(right.values()) >= 0.95 * sum(total.values()), (right, total)


def test_identify_equals_one_text_at_a_time(spark):
    """Sizes under each language's dictionary by a fresh compressor a text, the smallest chosen."""
    import zstandard

    docs = duck().execute("SELECT doc_id, text, lang FROM documents").fetchall()
    known = langid.learn(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out(F.col("doc_id"))))
    found = {r["doc_id"]: r for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet"), known).collect()}
    for i, t, _ in docs:
        if not t or not any(c.isalpha() for c in t):
            assert found[i]["lang_pred"] == "und" and found[i]["rejected"]
            continue
        raw = t.lower().encode() + b" " * 64
        n = math.ceil(len(raw) / 16384)
        step = math.ceil(len(raw) / n)
        sizes = {}
        for lang, content in known.items():
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False).compress(raw[a : a + step])) for a in range(0, len(raw), step))
        least, second = sorted(sizes.values())[:2]
        assert sizes[found[i]["lang_pred"]] == least and found[i]["score"] == pytest.approx((second - least) / second)
        assert found[i]["rejected"] == (found[i]["score"] < langid.MIN_MARGIN)


def test_identify_agrees_with_letters(spark):
    """A classifier of another kind, naive Bayes on runs of three characters, learned from the same rows, names the same language for nearly all held-out documents of some length."""
    docs = duck().execute("SELECT doc_id, text, lang FROM documents").fetchall()
    found = {r["doc_id"]: r["lang_pred"] for r in queries.op6_language(spark, SF).collect()}
    runs = lambda t: [t[k : k + 3] for k in range(len(t) - 2)]
    counts: dict[str, Counter] = defaultdict(Counter)
    for i, t, lang in docs:
        if t and lang and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(runs(t.lower()))
    every = set().union(*counts.values())
    logs = {lang: {g: math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(every))) for g in every} for lang, c in counts.items()}
    same = total = 0
    for i, t, _ in docs:
        if t and zlib.crc32(str(i).encode()) % 4 == 2 and n_words(t) >= 20:
            scores = {lang: sum(table[g] for g in runs(t.lower()) if g in every) for lang, table in logs.items()}
            total += 1
            same += max(scores, key=scores.get) == found[i]
    assert total >= 20 and same >= 0.97 * total, (same, total)


def test_dots_in_names(spark):
    """Ids and texts may be columns with dots in their names."""
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "s"), (2, None, None), (3, "le chat", "s")], "`a.id` long, `a.text` string, source string")
    assert mixing.mix_sources(docs, id_col="a.id", text_col="a.text").count() == 3
    assert sharding.balanced_shards(docs, 2, "a.id", "a.text").columns[0] == "a.id"
    assert jaccard.similar_documents(docs, "a.id", "a.text").count() == 3
    assert quality.judge_quality(docs, "a.id", "a.text").columns[0] == "a.id"
    assert media.document_media(docs, "a.id", "a.text").columns[0] == "a.id"


def test_op7_query(spark, documents):
    want = Counter()
    for i, t, _, _ in documents:
        raw = (t or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = f"P5\n576 {len(full) // 576}\n255\n".encode() + full
        bins = [0] * 16
        for byte in full:
            bins[byte // 16] += 1
        feature = f"rows={len(full) // 576};mean={sum(full) * 100 // len(full)};hist={','.join(str(b * 1000 // len(full)) for b in bins)}"
        want[(i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)] += 1
    cols = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    assert Counter(tuple(r) for r in queries.op7_media(spark, SF).select(*cols).collect()) == want


@pytest.mark.parametrize(("hot", "bound"), [(1, 1 << 25), (1, 0), (256, 1 << 25)])
def test_media_of_hot_digests(spark, monkeypatch, hot, bound):
    """A payload that half of the documents share, by the broadcast of hot rows, by salted keys, and plainly."""
    monkeypatch.setattr(media, "HOT_PARTS", hot)
    monkeypatch.setattr(media, "BROADCAST_BYTES", bound)
    docs = spark.createDataFrame([(i, "shared" if i % 2 else f"own {i // 3}") for i in range(60)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["payload_sha256"]) for r in media.document_media(docs).collect()}
    text_of = {i: ("shared" if i % 2 else f"own {i // 3}").encode() for i in range(60)}
    assert got == {i: (len(t), hashlib.sha256(t + b"\xff" * (576 - len(t))).hexdigest()) for i, t in text_of.items()}


def test_archives_of_hot_digests(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "x" * 200 if i % 2 else f"{i}" * 120) for i in range(40)], "page_id long, url string, html string")
    want = sorted(map(str, warc.archive_pages(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    assert sorted(map(str, warc.archive_pages(pages).collect())) == want
    named = pages.withColumn("page_id", F.concat(F.lit("p/ ä+%"), F.col("page_id").cast("string")))
    got = {r["page_id"]: r["refers_to"] for r in warc.archive_pages(named).collect()}
    assert got == {f"p/ ä+%{i}": "p/ ä+%1" if i % 2 and i != 1 else None for i in range(40)}


def test_op8_query(spark, documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rows = queries.op8_pieces(spark, SF).collect()
    assert len(rows) == len(documents) and all(r["round_trip"] for r in rows)
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in rows) == Counter((i, tuple(lib.encode(t or ""))) for i, t, _, _ in documents)


def test_op9_query(spark, documents):
    """Shard and slot of each row by one pass over the sorted rows."""
    rows = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for i, t, _, _ in documents), key=lambda r: (r[0] is not None, r))
    total, before, slots, want = sum(r[2] for r in rows), 0, Counter(), Counter()
    for i, crc, size in rows:
        shard = min(39, (2 * before + size) * 40 // (2 * total))
        want[(i, size, crc, shard, slots[shard])] += 1
        slots[shard] += 1
        before += size
    got = queries.op9_shards(spark, SF)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "text_crc32", "shard", "slot").collect()) == want


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i % 7, f"t{i % 3}", i) for i in range(40)], "doc_id long, text string, extra long").repartition(3)
    path = str(tmp_path / "out")
    sharding.write_shards(docs, path, 4)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "extra").collect()) == Counter(tuple(r) for r in docs.collect())
    want = Counter(r["shard"] for r in sharding.balanced_shards(docs, 4).collect())
    assert Counter(r["shard"] for r in back.collect()) == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), path, 4)
    odd = spark.createDataFrame([(None, None), (None, ""), (1, LONG), (1, LONG), (2, "x")] + [(7, "same")] * 50, "doc_id long, text string").repartition(3)
    sharding.write_shards(odd, f"{path}-odd", 4)
    back = spark.read.parquet(f"{path}-odd")
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, odd.collect())) and len({r["shard"] for r in back.collect()}) > 1
    for shard in (r["shard"] for r in back.select("shard").distinct().collect()):
        ids = [r["doc_id"] for r in spark.read.parquet(f"{path}-odd/shard={shard}").collect()]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))


def plain_votes(text: str) -> list[int]:
    """The seven rules, one by one, on one text."""
    raw, w = text.encode(), WORD.findall(text)
    n, chars = len(w), max(1, len(text))
    words, symbols, dup, repeats = brute_quality(text)[1:5]
    letters = sum(c.isalpha() for c in text)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    short, mean = sum(len(x) < 30 for x in lines), words / max(1, n)
    vote = lambda good, poor: -1 if poor else 1 if good else 0
    return [
        vote(100 * symbols <= n, 10 * symbols > n),
        vote(3 <= mean <= 8, mean < 2 or mean > 15),
        vote(100 * letters >= 76 * chars, 100 * letters < 72 * chars),
        vote(len(lines) >= 2 and dup == 0, 10 * dup > 3 * len(lines)),
        vote(n >= 50 and repeats == 0, 10 * repeats > 3 * n),
        vote(len(lines) >= 3 and 10 * short <= 3 * len(lines), len(lines) >= 3 and 10 * short > 9 * len(lines)),
        vote(n >= 50 and 10 * len(set(w)) >= 3 * n, n >= 50 and 10 * len(set(w)) < n),
    ]


def test_op10_query(spark, documents):
    """Votes, posterior and verdict by an expectation-maximisation over documents rather than vote patterns, in plain loops."""
    votes = {i: plain_votes(t) for i, t, _, _ in documents if t and WORD.search(t)}
    every = list(votes.values())
    good = [min(0.99, max(0.01, 0.5 + 0.49 * sum(v) / max(1, sum(map(abs, v))))) for v in every]
    share, rate = 0.5, []
    for _ in range(quality.EM_STEPS):
        share = min(0.99, max(0.01, sum(good) / len(every)))
        rate = []  # of each rule the probability of a poor vote, for poor and good documents
        for r in range(7):
            sums = [[1.0, 1.0], [1.0, 1.0]]
            for v, g in zip(every, good, strict=True):
                if v[r]:
                    sums[0][v[r] > 0] += 1 - g
                    sums[1][v[r] > 0] += g
            poor, fine = (a / (a + b) for a, b in sums)
            rate.append((max(poor, fine), fine))
        new = []
        for v in every:
            odds = math.log(share) - math.log(1 - share)
            for x, (poor, fine) in zip(v, rate, strict=True):
                odds += math.log(fine / poor) if x < 0 else math.log((1 - fine) / (1 - poor)) if x > 0 else 0.0
            new.append(1 / (1 + math.exp(-odds)))
        moved, good = max(abs(a - b) for a, b in zip(new, good, strict=True)), new
        if moved < 1e-9:
            break
    want = dict(zip(votes, good, strict=True))
    rows = {r["doc_id"]: r for r in queries.op10_quality(spark, SF).collect()}
    assert len(rows) == len(documents)
    for i, r in rows.items():
        if i not in want:
            assert r["posterior"] is None and not r["kept"]
            continue
        assert r["posterior"] == pytest.approx(want[i], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= quality.MIN_POSTERIOR)
    assert 0 < sum(r["kept"] for r in rows.values()) < len(rows)


def test_op10_verdict_follows_the_labels(spark):
    """Documents labelled good are kept more often than those labelled poor."""
    kept = {r["doc_id"]: r["kept"] for r in queries.op10_quality(spark, SF).collect()}
    shares = defaultdict(list)
    for i, q in duck().execute("SELECT doc_id, quality FROM labels").fetchall():
        shares[q].append(kept[i])
    assert np.mean(shares[1]) > np.mean(shares[0]) + 0.2, {q: np.mean(v) for q, v in shares.items()}


def test_interleaved_pages(spark):
    rows = queries.interleaved_pages(spark, SF).collect()
    n = duck().execute("SELECT count(*) FROM pages").fetchone()[0]
    assert len({r["page_id"] for r in rows}) == n and all(r["text"] or r["ref"] or r["pos"] is None for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r["pos"])
    assert all(sorted(p) == list(range(len(p))) or p == [None] for p in by.values())


def test_empty_batch_of_texts():
    assert list(jaccard.shingle_sets(pa.array([], pa.binary()))) == [] and pieces.encoder().encode([])[0].tolist() == []
