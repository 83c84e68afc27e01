"""Each operator on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckloom.llm import bloom, components, jaccard, langid, linededup, media, mixing, pieces, quality, sharding, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, _kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows() -> list[tuple]:
    """Null columns, empty and very long texts, ties, repeated rows; columns named like results."""
    long_text = " ".join(f"w{i % 977}" for i in range(30000))
    base = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a", 1, 7, 7),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 7, 7),
        (4, long_text, "en", "b", 1, 7, 7),
        (5, "line one is here\nline one is here\n\n  \nother line", None, "b", 1, 7, 7),
        (5, "line one is here\nline one is here\n\n  \nother line", None, "b", 1, 7, 7),
        (6, "the cat sat on the mat and looked at the dog", "en", "c", 1, 7, 7),
        (None, "nobody knows this row at all", None, "c", 1, 7, 7),
        (7, "日本語 🙂 naïve\tcafé\x0bx", "fr", "ü", 1, 7, 7),
        (8, "THE CAT sat on the mat and looked at the dog", "en", "c", 1, 7, 7),
    ]
    return base


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def n_words(text):
    return len(WORD.findall(text or ""))


def test_shards(odd, empty):
    rows = sharding.balanced_shards(odd, 3).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(r["size"] for r in rows) == sorted(len((t[1] or "").encode()) + 16 for t in odd_rows())
    crcs = Counter(zlib.crc32((t[1] or "").encode()) for t in odd_rows())
    assert Counter(r["text_crc32"] for r in rows) == crcs
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.balanced_shards(empty, 3).count() == 0


def test_shards_balanced(spark):
    rows = [(i, "x" * ((i * 37) % 200)) for i in range(500)] + [(0, "x")] * 300
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    total = sum(r["s"] for r in got)
    assert len(got) == 10 and all(abs(r["s"] - total / 10) <= 216 for r in got)
    ordered = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 10).orderBy("shard", "slot").collect()
    assert [r["doc_id"] for r in ordered] == sorted(r["doc_id"] for r in ordered)


def fill(sizes: dict) -> dict:
    """Targets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, budget, out = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        room = budget - sum(out.values())
        share = {s: room * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left.discard(s)
    return out


def test_mix(odd, empty):
    rows = mixing.mix_sources(odd).collect()
    sizes = Counter()
    for t in odd_rows():
        sizes[t[3]] += n_words(t[1])
    want, taken = fill(dict(sizes)), Counter()
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(odd).collect()))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 4}" if i % 5 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += n_words(t)
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += n_words(r["text"])
    assert all(abs(got[s] - t) <= 9 for s, t in fill(dict(sizes)).items())


def test_sampling_prefers_quality(spark):
    keys = spark.range(4000).select(mixing.sampling_key(F.col("id"), F.lit(1.0)).alias("a"), mixing.sampling_key(F.col("id"), F.lit(0.1)).alias("b")).agg(F.avg("a"), F.avg("b")).first()
    assert keys[0] == pytest.approx(1.0, abs=0.1) and keys[1] == pytest.approx(10.0, abs=1.0)


def brute_rule(url: str | None, rules) -> tuple:
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit) if fit else None
    return host, path, best and best[3], best[4] if best else "allow"


URLS = ["http://A.Example.com/en/7x?q", "https://example.com/en/8", "http://com/en/", "x://notcom/en/", "ftp://a.net/de/8/9#f", "http://b.example.net/de/81", "http://q.org/es/", "http://q.org/e", None, "no url", "://", "http://", "http://h" + "a." * 3000 + "com/en/x", "http://com:80/en/"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    for rules in (urls.RULES, (), (("block", "", ""),), (("allow", "com", "/en/"), ("block", "com", "/en/"))):
        frame = urls.rules_frame(spark, rules) if rules else spark.createDataFrame([], "verdict string, rule_host string, rule_path string")
        rows = urls.judge_urls(pages, frame).collect()
        assert len(rows) == len(pages.collect())
        for r in rows:
            want = brute_rule(URLS[r["page_id"] % len(URLS)], [x for x in rules if x[1]])
            if rules and rules[0][1] == "":
                want = (*want[:2], "", "block")  # an empty rule fits every url
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == want, (r, want)
    assert urls.judge_urls(pages.limit(0), urls.rules_frame(spark)).count() == 0


def test_urls_by_join_agree(spark, monkeypatch):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    want = sorted(map(str, urls.judge_urls(pages, urls.rules_frame(spark)).collect()))
    monkeypatch.setattr(bloom, "MAX_BITS", 1)
    assert sorted(map(str, urls.judge_urls(pages, urls.rules_frame(spark)).collect())) == want


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(*[h.alias(n) for h, n in zip(bloom.key_hashes(F.col("id")), ("h1", "h2"), strict=True)], "id")
    made = bloom.cascade(keys.where("id % 17 = 0"), keys, 3000)
    rows = keys.collect()
    h1, h2 = (np.array([r[c] for r in rows], dtype=np.int64).view(np.uint64) for c in ("h1", "h2"))
    assert made.contains(h1, h2).tolist() == [r["id"] % 17 == 0 for r in rows]
    assert len(made.levels) > 2


def test_warc(spark):
    big = "<html>" + "x" * 200
    rows = [(3, "http://a", big), (1, "http://ä/ b", big), (None, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "\r\n\r\nWARC/1.0" * 30), (9, "u", "é" * 50), (10, "u", "é" * 50), (1, "x", big)]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        again = len(raw) >= 100 and sum((h or "").encode() == raw for _, _, h in rows) > 1 and i != min(same)
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in t)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_frames_and_errors():
    records = [warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).digest(), None, False) for i, body in enumerate(b"<p>page %d</p>" % i * (i % 60 + 1) for i in range(300))]
    data = warc.archive(records)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.split_records(data)) == records
    assert list(warc.split_records(memoryview(data))) == records
    with pytest.raises(ValueError):
        list(warc.split_records(data[:-3]))
    good = records[5]
    for bad in (good.replace(b"Content-Length", b"Content-Longth", 1), good[:-5] + b"x\r\n\r\n", good + b"x", good.replace(b"page 5", b"page 6", 1), b"", good.replace(b"WARC/1.1", b"HTTP/1.1", 1)):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_language(spark, odd, empty):
    lang = {"xx": "zork blat fumo gripe neral", "yy": "chlo dwen ystr afon llyn"}
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(lang[k].split()) for _ in range(40)), k) for i in range(400) for k in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in langid.identify(docs, known).collect()}
    assert all(got[i]["lang_pred"] == k and not got[i]["rejected"] and 0 <= got[i]["score"] <= 1 for i, _, k in rows)
    rows = {r["doc_id"]: r for r in langid.identify(odd, known).collect()}
    assert rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[2]["score"] == 0.0 and len(rows) == 9
    assert langid.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.learn(empty) == {} and langid.identify(empty, known).count() == 0
    assert set(langid.accepted_documents(odd, known).columns) == set(odd.columns)


def tongue_rows(seed: int) -> tuple[list[tuple], list[tuple]]:
    """(id, text, lang) of short texts in three languages of 600 words each, and of texts of 20,000 to 80,000 words in them."""
    rnd = random.Random(seed)
    words = {k: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 9))) for _ in range(600)] for k, letters in (("xx", "abcdefghijklmno"), ("yy", "ghijklmnopqrstu"), ("zz", "adgjmpsvybehknqt"))}
    weight = [1 / (1 + i) ** 0.7 for i in range(600)]
    text = lambda k, n: " ".join(rnd.choices(words[k], weight, k=n))
    short = [(i, text(k, 120), k) for i in range(900) for k in [("xx", "xx", "yy", "zz")[i % 4]]]
    return short, [(10000 + n + j, text(k, n), k) for n in (20000, 40000, 80000) for j, k in enumerate(words)]


def test_language_of_very_long_texts(spark):
    """The margin doesn't fall with length: a dictionary counts as much in a long text as in a text of one block."""
    short, long = tongue_rows(4)
    schema = "doc_id long, text string, lang string"
    known = langid.learn(spark.createDataFrame(short, schema))
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(long, schema), known).collect()}
    assert {i: (r["lang_pred"], r["rejected"]) for i, r in got.items()} == {i: (k, False) for i, _, k in long}
    made = langid.packers(known)
    for i, text, _ in long:
        assert got[i]["score"] > 0.8 * langid.classify(text[: langid.BLOCK_BYTES - 1000].encode(), made)[1]
    block = b"x" * langid.BLOCK_BYTES
    assert langid.classify(block, made)[1] >= 0 and langid.classify(b"", made)[1] >= 0


def test_media(spark, odd, empty):
    rows = media.document_media(odd).collect()
    assert len(rows) == len(odd_rows())
    want = Counter()
    for t in odd_rows():
        raw = (t[1] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = media.to_image(full)
        want[(t[0], len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]), len(image), hashlib.sha256(image).hexdigest(), media.image_features(memoryview(full)))] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], r["feature"]) for r in rows) == want
    assert media.document_media(empty).count() == 0


def test_interleaved_parts(spark):
    html = "<head><title>no</title></head><p>One &amp; two<img src='a.png' alt='alt'>after<figure><img src=b.png><figcaption>cap <b>tion</b></figcaption></figure><script>x</script><p>end"
    parts = media.parse_parts(html)
    assert [(p["pos"], p["kind"], p["text"] or p["ref"], p["caption"]) for p in parts] == [(0, "text", "One & two", None), (1, "media", "a.png", "alt"), (2, "text", "after", None), (3, "media", "b.png", "cap tion"), (4, "text", "end", None)]
    assert media.parse_parts(None) == media.parse_parts("") == []
    digest = hashlib.sha256(b"x").hexdigest()
    docs = spark.createDataFrame([(1, f"<p>t</p><img src='media:{digest}'><img src='media:{'0' * 64}'>"), (2, None)], "doc_id long, html string")
    table = spark.createDataFrame([(digest, bytearray(b"x"))], "digest string, media binary")
    rows = media.resolve(media.interleaved(docs, "html", ("doc_id",)), table, "doc_id").orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["pos"], r["media"] and bytes(r["media"])) for r in rows] == [(1, 0, None), (1, 1, b"x"), (1, 2, None), (2, None, None)]
    with pytest.raises(ValueError):
        media.from_image(b"P5\n576 1\n255\nxx")


def test_pieces_equal_the_library(spark, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["", " ", "a", "  hello   world  ", "日本語テキスト" * 40, "x" * 3000, "\n\n\t foo▁bar", "<s> <unk> <0x41>", "🙂🙂 zzz", "é" * 300 + " ", "a  b                     c", "The quick brown fox jumps over 12345 lazy dogs."]
    texts += [t[1] for t in odd_rows() if t[1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.encode_texts(docs).collect()}
    assert all(got[i]["token_ids"] == lib.encode(t) and got[i]["round_trip"] for i, t in enumerate(texts))
    back = pieces.decode_ids(pieces.encode_texts(docs), ("doc_id",)).collect()
    assert all(r["text"] == texts[r["doc_id"]].replace("▁", " ") for r in back)
    assert pieces.encode_texts(odd).where("n_tokens = 0").count() == 2
    assert pieces.encode_texts(empty).count() == 0


def test_unigram_is_the_best_path():
    plain = {b" a": -1.0, b"b": -2.0, b" ab": -2.5, b"c": -1.5, b"bc": -1.0, b" ": -3.0, b"a": -3.0}
    names = sorted(plain)
    vocab = pieces.Vocabulary(names, np.arange(len(names), dtype=np.int32), np.array([plain[n] for n in names]), np.arange(100, 356, dtype=np.int32), names, False, 0)
    ids, _ = pieces.Encoder(vocab).segments([b" abc", b" ab", b" az"])
    assert [names[i] if i < 100 else i for i in ids.tolist()] == [b" a", b"bc", b" ab", b" a", 100 + ord("z")]


def test_long_segments_merge_alike():
    own = pieces.encoder()
    text = ("internationalization" * 40).encode()
    a, _ = own.segments([b" " + text])
    import sentencepiece

    assert a.tolist() == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(text.decode())


def brute_quality(text):
    w = WORD.findall(text or "")
    seen, cover = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, odd, empty):
    rows = quality.judge_quality(odd).collect()
    want = Counter((t[0], *brute_quality(t[1])) for t in odd_rows())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in rows)
    assert quality.judge_quality(empty).count() == 0


def test_quality_fit_finds_good_rules():
    rnd = np.random.default_rng(3)
    truth = rnd.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.75])
    votes = np.where(rnd.random((4000, 4)) < right, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rnd.random((4000, 4)) < 0.1] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, table = quality.fit(patterns, counts)
    assert share == pytest.approx(0.7, abs=0.05)
    found = quality.posterior(votes, share, table) >= 0.5
    assert (found == truth).mean() > 0.95
    assert (table[1, 0, 1] > table[1, 3, 1]) and (table[0, 0, 0] > table[0, 3, 0])


def test_within_is_edit_distance():
    rnd = random.Random(0)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randrange(9))) for _ in range(2))
        for k in (1, 2, 3):
            assert linededup.within(a, b, k) == (linededup._distance(a, b) <= k)
    assert linededup.within("x" * 5000 + "a" + "y" * 5000, "x" * 5000 + "y" * 5000, 1)


def brute_lines(rows, k=linededup.THRESHOLD, share=linededup.SHARE, unit=linededup.UNIT):
    """rows (id, text): kept text of each by comparing every line with all before it."""
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None}, key=lambda x: x[:2])
    before, out = [], {}
    for has, i, t in order:
        keep = []
        for line in t.split("\n"):
            if not WORD.search(line):
                keep.append(line)
                continue
            own = WORD.findall(line) if unit == "word" else line
            room = [min(k, int(share * max(len(b), len(own)) + 1e-9)) for b in before]
            if not any(b == own or (r and abs(len(b) - len(own)) <= r and linededup._distance(b, own) <= r) for b, r in zip(before, room, strict=True)):
                keep.append(line)
            before.append(own)
        out[(i if has else None, t)] = "\n".join(keep)
    return out


def line_rows(seed: int) -> list[tuple]:
    """(id, text): lines that are some edits of words and characters away from a few others; null and repeated rows, odd white space."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [[rnd.choice(words) for _ in range(n)] for n in (3, 9, 10, 12, 19, 20, 21, 26, 40)]
    rows = [(None, "first of all, a null id line\nshort")]
    for i in range(60):
        lines = []
        for _ in range(4):
            own = list(rnd.choice(base))
            for _ in range(rnd.randrange(4)):
                at = rnd.randrange(len(own))
                rnd.choice([lambda: own.__setitem__(at, rnd.choice(words) + "x"), lambda: own.insert(at, "new"), lambda: own.pop(at)])() if len(own) > 1 else None
            lines.append(rnd.choice([" ", " ", "  "]).join(own))
        rows.append((i, "\n".join([*lines, "", "  "])))
    return [*rows, rows[5], (200, None), (201, ""), (202, rows[9][1])]


@pytest.mark.parametrize(("k", "share", "unit", "hot", "levels"), [(2, 0.1, "word", 48, 3), (2, 0.1, "word", 2, 3), (1, 0.1, "word", 2, 1), (3, 0.15, "word", 4, 2), (1, 0.1, "char", 48, 3), (2, 0.1, "char", 3, 2)])
def test_line_dedup(spark, monkeypatch, k, share, unit, hot, levels):
    """With a low ``hot`` nearly all lists are long ones; every way gives what brute force gives."""
    monkeypatch.setattr(linededup.near_lines, "__defaults__", (unit, k, share, hot, levels))
    rows = line_rows(7)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_kept string").repartition(3)
    want = brute_lines(rows, k, share, unit)
    got = linededup.dedup_lines(docs, k=k, share=share, unit=unit).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, want.get((i, t))) for i, t in rows)
    assert all(r["n_lines"] == r["n_kept"] + r["n_exact"] + r["n_near"] for r in got)
    assert sum(r["n_near"] for r in got) > (10 if k > 1 or unit == "word" else 2)  # words are edited: few lines are one character apart
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_equal_lines_only(spark):
    rows = line_rows(8)
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), k=0).collect()
    want = brute_lines(rows, 0, 0.0)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, want.get((i, t))) for i, t in rows)
    assert not any(r["n_near"] for r in got)


def test_line_dedup_finds_single_words(spark):
    """One word changed, put in or left out of a line of ten words and more makes a near copy; of five words, another line."""
    long, few = "one two three four five six seven eight nine ten eleven", "one two three four five"
    texts = [long, long.replace("five", "FIVE"), f"new {long}", long.replace(" six", ""), few, few.replace("two", "too")]
    got = linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_near"] for r in got] == [0, 1, 1, 1, 0, 0]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = defaultdict(list)
    for x, (i, _) in zip(label, rows, strict=True):
        if i is not None:
            ids[x].append(i)
    return [(i, len(s), min(ids[x]) if ids[x] else None) for (i, _), s, x in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize("light", [32, 1])
def test_jaccard_components(spark, odd, empty, monkeypatch, light):
    """With ``light`` 1 every list goes by centres and then by what is left; both give what brute force gives."""
    monkeypatch.setattr(jaccard, "LIGHT_LIST", light)
    rnd = random.Random(11)
    words = [f"t{i}" for i in range(300)]
    rows = [(t[0], t[1]) for t in odd_rows()]
    at = 100
    for size in (1, 3, 4, 5, 6, 7, 9, 12, 15, 20, 26, 31, 60, 150):
        for _ in range(3):
            base = [rnd.choice(words) for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(rnd.randrange(4)):
                    own[rnd.randrange(size)] = rnd.choice(words)
                rows.append((at, " ".join(own[: rnd.choice([size, size, max(1, size - 1)])])))
                at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs).collect())
    assert got == Counter(brute_components(rows))
    assert jaccard.similar_documents(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def unequal_pairs(seed: int, first: int = 0) -> list[tuple]:
    """(id, text) of pairs, each of words of its own: a text and the same with words appended or less its last ones, Jaccard 0.77 to 0.87."""
    rnd, rows = random.Random(seed), []
    for k in range(120):
        size = rnd.randrange(30, 240)
        own = [f"u{seed}p{k}w{j}" for j in range(size)]
        other = rnd.choice([[*own, *(f"u{seed}q{k}w{j}" for j in range(round((size - 4) * rnd.uniform(0.15, 0.3))))], own[: round((size - 4) * rnd.uniform(0.77, 0.87)) + 4]])
        rows += [(first + 2 * k, " ".join(own)), (first + 2 * k + 1, " ".join(other))]
    return rows


@pytest.mark.parametrize("light", [32, 1])
def test_jaccard_of_unequal_lengths(spark, monkeypatch, light):
    """Isolated pairs of near copies, one of them longer: no other set helps them to meet."""
    monkeypatch.setattr(jaccard, "LIGHT_LIST", light)
    rows = unequal_pairs(3)
    # a frame of words that many texts have makes the pairs' shared shingles the frequent ones
    common = [f"c{j}" for j in range(80)]
    rows += [(1000 + k, " ".join([*common, *(f"v{k}w{j}" for j in range(15 + k))])) for k in range(10)]
    rows += [(1100, " ".join(common)), (1101, " ".join(common[:70]))]
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_components(rows)
    assert sum(i != c for i, _, c in want) > 40
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)


@pytest.mark.parametrize("small", [0, 24])
def test_prefix_keys_meet(small):
    """Any two sets of Jaccard 0.8 share a key, on both sides of the boundary and with any table of frequent tokens."""
    rnd = np.random.default_rng(5)
    for _ in range(400):
        n = int(rnd.integers(1, 45))
        a = np.unique(rnd.integers(0, 1 << 62, n, dtype=np.uint64))
        keep = a[rnd.random(len(a)) < 0.93]
        b = np.unique(np.concatenate((keep, rnd.integers(0, 1 << 62, int(rnd.integers(0, 3)), dtype=np.uint64))))
        shared = len(np.intersect1d(a, b))
        if not len(a) or not len(b) or 100 * shared < 80 * (len(a) + len(b) - shared):
            continue
        frequent = np.sort(rnd.choice(a, max(1, len(a) // 2), replace=False))
        level = rnd.integers(2, 9, len(frequent)).astype(np.int8)
        x, y = (jaccard.prefix_keys(s, frequent, level, small) for s in (a, b))
        assert len(np.intersect1d(x, y)), (len(a), len(b), shared)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7000)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(50)) and got[7000] == 7000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
