"""The ten operators against brute force: small tables with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from shoalkv.llm import bpe, common, components, dedup, langid, licenses, lines, lm, mixing, near, quality, registry, simhash, substrings

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def prose(rng, n, kinds=40):
    return " ".join(rng.choice(VOCABULARY[:kinds]) for _ in range(n))


VOCABULARY = ["".join(random.Random(i).choice("abcdeéßñ") for _ in range(2 + i % 6)) + str(i % 3) for i in range(400)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 300), 400) for _ in range(60)]
    shared = prose(rng, 70, 400)
    out = [(i, t, ("en", "de", None)[i % 3], f"src{i % 5}", len(t)) for i, t in enumerate(base)]
    out += [(100 + i, base[i].replace(" ", " \n\t" if i % 2 else "  "), "en", "src1", 0) for i in range(10)]
    out += [(200 + i, prose(rng, 30, 400) + " " + shared + "\n" + prose(rng, i, 400), "de", "src0", 0) for i in range(8)]
    out += [(300 + i, " ".join(base[20 + i].split()[:-1] + ["changed"]), "en", None, 0) for i in range(10)]
    out += [(400, None, None, None, None), (401, "", "en", "src2", 0), (402, " \n ", "fr", "src2", 3), (403, None, "en", "src0", None)]
    out += [(404, "Under the MIT License. Licensed under CC BY-NC 4.0, and cc by nc again\n" * 3, "en", "src0", 0)]
    out += [(405, "GNU General Public License, version 3; apache license\nversion 2", "en", "src0", 0), (406, "12 34 !!", "en", "x", 0)]
    out += [(None, base[0], "en", "src0", 0), (None, prose(rng, 90, 400), "en", "src0", 0), (5, base[5], "en", "src0", 0), (5, base[5], "en", "src0", 0)]
    out += [(407, prose(rng, 40_000, 400), "en", "src3", 0), (408, ("line of words here\n" * 80), "en", "src3", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(*r, 1, "x", -1) for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", row int, norm string, first int").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def keyed(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


# 1: BPE.


@pytest.fixture(scope="module")
def codec():
    return registry.codec()


def encoding(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_matches_tiktoken(docs, rows, codec):
    want, own = [], encoding(codec)
    for r in rows:
        text = r[1] or ""
        ids = own.encode_ordinary(text)
        want.append((r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert keyed(bpe.digests(docs, codec), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_bpe_of_awkward_texts(codec):
    rng, own = random.Random(2), encoding(codec)
    for _ in range(1500):
        text = "".join(rng.choice("ab \n\t'sé漢🎉١²ʰ́\x1c\x85ſK0.,") for _ in range(rng.randint(0, 40)))
        ids = own.encode_ordinary(text)
        packed = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids)}I", packed)) == ids and codec.decode(packed) == text.encode()
    long = "ab" * 20_000 + "é" * 5000
    assert codec.decode(codec.encode(long)) == long.encode()


def test_the_hash_is_minimal_and_perfect():
    keys = [b"k%d" % i for i in range(5000)] + [b""]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slot_of.tolist()) == list(range(len(keys)))
    assert table.find(keys) == list(range(len(keys))) and set(table.find([b"absent", b"k-1", b"5"])) == {-1}


def test_bpe_forgets_without_a_change(codec, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 2000)
    own = encoding(codec)
    for text in [*(f"word{i} again{i % 3}" for i in range(30)), "x" * 3000, "", "word1 again1"]:
        assert list(struct.unpack(f"<{len(codec.encode(text)) // 4}I", codec.encode(text))) == own.encode_ordinary(text)
        assert len(codec._memo) * bpe.ENTRY <= codec._held <= 2000 + 4 * (3000 + bpe.ENTRY)


def test_bpe_in_one_pass_is_both(docs, codec):
    """Output names that clash with columns replace these, in any case of letters."""
    apart = bpe.decode(bpe.encode(docs, codec, ids="norm"), codec, ids="norm", data="LANG")
    both = bpe.coded(docs, codec, ids="norm", data="LANG")
    assert both.columns == apart.columns and both.columns[-2:] == ["norm", "LANG"] and "lang" not in both.columns
    assert sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def test_bpe_keeps_other_columns_and_lists_ids(spark, docs, empty, codec):
    got = bpe.encode(docs.where("doc_id = 405"), codec).withColumn("list", bpe.id_list("ids")).first()
    assert got.list == encoding(codec).encode_ordinary(got.text) and got.norm == "x"
    assert bpe.encode(docs.where("doc_id = 401"), codec).withColumn("list", bpe.id_list("ids")).first().list == []
    assert bpe.encode(docs, codec, ids="norm").columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "first", "norm"]
    assert bpe.digests(empty, codec).count() == 0
    with pytest.raises(ValueError):
        codec.decode(struct.pack("<I", 60_000))


# 2: exact dedup.


def dedup_brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return groups, sorted(out, key=str)


@pytest.mark.parametrize("files,digest_bytes", [(1000, 32), (1, 32), (1000, 1)])
def test_dedup(docs, rows, files, digest_bytes):
    """One micro-batch or several; a digest of one byte makes different texts collide, which full bytes tell apart."""
    got = dedup.classes(docs, files=files, digest_bytes=digest_bytes).cache()
    groups, want = dedup_brute(rows)
    assert keyed(got, "doc_id", "keep_id", "group_size") == sorted((w[:3] for w in want), key=str)
    if digest_bytes == 32:
        assert keyed(got.withColumn("sha", F.lower(F.hex("digest"))), "doc_id", "keep_id", "group_size", "sha") == want
    assert got.where("kept").count() == len(groups)
    assert all(r.doc_id == r.keep_id for r in got.where("kept").collect())


def test_dedup_keeps_rows_and_columns(docs, rows, empty):
    got = dedup.distinct(docs)
    assert got.columns == docs.columns and got.count() == len(dedup_brute(rows)[0])
    assert dedup.classes(empty).count() == 0 and dedup.distinct(empty).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_dedup_joins_hits_that_are_too_many_to_send(docs, rows, monkeypatch, digest_bytes):
    monkeypatch.setattr(dedup, "BROADCAST", 0)
    got = dedup.classes(docs, digest_bytes=digest_bytes).cache()
    assert keyed(got, "doc_id", "keep_id", "group_size") == sorted((w[:3] for w in dedup_brute(rows)[1]), key=str)
    assert got.where("kept").count() == len(dedup_brute(rows)[0])


def test_dedup_meets_the_state_of_earlier_calls(spark, rows, tmp_path):
    """Three calls on one folder, each of another session: what a call returns is its own rows, against all so far."""
    own = [r for r in rows if r[0] is not None]
    parts, seen = [own[0::3], own[1::3], own[2::3]], []
    for part in parts:
        seen += part
        session = spark.newSession()
        got = dedup.classes(session.createDataFrame(part, SCHEMA), state=str(tmp_path / "state"), files=1)
        want = Counter(w[:3] for w in dedup_brute(seen)[1])
        found = Counter((r.doc_id, r.keep_id, r.group_size) for r in got.collect())
        assert sum(found.values()) == len(part) and not found - want
    for _ in range(3):  # files have names at random, which must not tell who was first
        again = dedup.distinct(spark.createDataFrame(parts[0], SCHEMA), state=str(tmp_path / "state"))
        assert again.count() == 0  # all of it has been met


# 3: PPM.


def ppm_brute(training, text, order):
    """The same model without pruning, from dictionaries, symbol by symbol."""
    counts = {}
    for t in training:
        s = b"\n" * order + lm.rendered((t or "").encode())[1]
        for p in range(order, len(s)):
            for j in range(order + 1):
                counts.setdefault(s[p - j : p], Counter())[s[p]] += 1
    s = b"\n" * order + lm.rendered((text or "").encode())[1]
    total = 0.0
    for p in range(order, len(s)):
        out = set()
        for j in range(order, -1, -1):
            own = {k: n for k, n in counts.get(s[p - j : p], {}).items() if k not in out}
            if s[p - j : p] not in counts or not own:
                continue
            n, t = sum(own.values()), len(own)
            if s[p] in own:
                total += math.log10(own[s[p]] / (n + t))
                break
            total += math.log10(t / (n + t))
            out |= set(own)
        else:
            total -= math.log10(256 - len(out))
    return total


def test_ppm_matches_symbol_by_symbol(spark, rows):
    small = [r for r in rows if len(r[1] or "") < 900][:60] + [(900, "zzz \x00\x00\x00\x00\x00\x00\x00 Ω 漢", "en", "s", 0)]
    frame = spark.createDataFrame(small, SCHEMA)
    training = [r[1] for r in small if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*(words((t or "").lower()) if (t or "").isascii() else [x.lower() for x in words(t)]), None])
    total, kinds = sum(counts.values()), len(counts)
    got = {(r.doc_id, round(r.score, 6)): r for r in lm.evaluate(frame).collect()}
    for i, text, *_ in small:
        tokens = [*[w.lower() for w in words(text)], None]
        r = got[i, round(ppm_brute(training, text, lm.ORDER), 6)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens))
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 7 == 2)


def test_ppm_is_a_distribution(spark, rows):
    """Over all 256 next bytes the probabilities sum to one, pruned or not."""
    frame = spark.createDataFrame(rows, SCHEMA)
    for share in (1e-6, 1e-3):
        trie = lm.train(frame, share=share)
        for context in (b"\n\n\n\n\n", b"abc0 ", b"\xff\xfe\xfd\xfc\xfb"):
            g = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
            assert (10 ** trie.cost(g)).sum() == pytest.approx(1.0)


def test_ppm_of_long_repeated_and_clashing_rows(spark, rows, monkeypatch):
    """Texts longer than a part, rows twice, and columns with the names of the result."""
    some = [(r[0], r[1], 1, "x", -1.0) for r in rows if len(r[1] or "") > 1000][:12]
    frame = spark.createDataFrame([*some, some[0], (None, None, None, None, None)], "doc_id long, text string, row int, gram string, score double")
    whole = keyed(lm.evaluate(frame).withColumn("s", F.round("score", 5)), "doc_id", "n_tokens", "s")
    monkeypatch.setattr(lm, "PART", 100)
    monkeypatch.setattr(lm, "SHARE", 1e-2)
    assert keyed(lm.evaluate(frame).withColumn("s", F.round("score", 5)), "doc_id", "n_tokens", "s") == whole and len(whole) == 14
    brute = [ppm_brute([t for i, t, *_ in [*some, some[0], (None, None)] if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2], t, lm.ORDER) for _, t, *_ in some[:2]]
    assert all(any(abs(b - w[2]) < 1e-4 for w in whole) for b in brute)


def test_ppm_words_beyond_the_sent_table_are_counted(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = keyed(lm.evaluate(frame).withColumn("b", F.round("base_score", 6)), "doc_id", "n_known", "b")
    monkeypatch.setattr(lm, "WORD_SHARE", 0.01)
    assert keyed(lm.evaluate(frame).withColumn("b", F.round("base_score", 6)), "doc_id", "n_known", "b") == whole


@pytest.mark.parametrize("split", [0, 40])
def test_ppm_of_crowded_contexts(spark, rows, monkeypatch, split):
    """All or some contexts dealt by a byte more, nothing sent apart, small tries: the scores are those of brute force."""
    monkeypatch.setattr(lm, "SHARE", 1)
    monkeypatch.setattr(lm, "PIECE", 300)
    monkeypatch.setattr(lm, "SPLIT", split)
    rng = random.Random(5)
    small = [r for r in rows if len(r[1] or "") < 900][:40] + [(900 + i, " ".join(f"{rng.getrandbits(24):x}" for _ in range(60)), "en", "s", 0) for i in range(14)]
    training = [r[1] for r in small if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2]
    with common.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "100"}):  # so that a partition has many tries
        got = sorted((str(r.doc_id), r.score) for r in lm.evaluate(spark.createDataFrame(small, SCHEMA)).collect())
    want = sorted((str(r[0]), ppm_brute(training, r[1], lm.ORDER)) for r in small)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-6)


@pytest.mark.parametrize("share", [1e-6, 1e-4])
def test_ppm_keeps_rare_strings_of_a_larger_corpus(spark, monkeypatch, share):
    """A corpus of more bytes than 1 / SHARE, of strings that mostly occur once, is scored as if nothing were sent apart."""
    monkeypatch.setattr(lm, "SHARE", share)
    monkeypatch.setattr(lm, "PIECE", 20_000)
    rng = random.Random(3)
    training = [prose(rng, 6_000, 400) + " " + " ".join(f"{rng.getrandbits(40):x}" for _ in range(12_000)) for _ in range(8)]
    assert sum(map(len, training)) > 1.01e6
    text = training[0][-300:] + " never met \x00 Ω"
    frame = spark.createDataFrame([(10 + i, t, "en", "s", 0) for i, t in enumerate(training)], SCHEMA)
    got = lm.score(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA), frame).first().score
    assert got == pytest.approx(ppm_brute(training, text, lm.ORDER), abs=1e-6)


def test_ppm_without_training(spark, rows, empty):
    assert lm.evaluate(empty).count() == 0
    frame = spark.createDataFrame([(1, "ab", "en", "s", 0)], SCHEMA)
    r = lm.score(frame, empty).first()
    assert r.score == pytest.approx(-3 * math.log10(256)) and (r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0)


# 4: licences.


def license_brute(text):
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = lambda p: [j for j in range(len(own)) if own[j : j + len(p.split())] == p.split()]
    starts = [j for p in licenses.BASE for j in at(p)]
    base = {label for p, (label, _) in licenses.BASE.items() if at(p)}
    more = {label for label, p, _ in licenses.TEMPLATES if at(p)}
    score = 0.0
    for t in licenses.ALL:
        for j in at(" ".join(t.key)):
            begin = j - t.key_at
            score = max(score, sum(0 <= begin + k < len(own) and own[begin + k] == w for k, w in enumerate(t.words)) / len(t.words))
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_licences(docs, rows, empty, monkeypatch, broadcast):
    monkeypatch.setattr(licenses, "BROADCAST", broadcast)
    got = licenses.scan(docs).withColumn("score", F.round("score", 9)).cache()
    assert keyed(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(((r[0], *license_brute(r[1])) for r in rows), key=str)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert 0 < scores[404] <= 1 and scores[401] == 0 and licenses.scan(empty).count() == 0


def test_a_line_of_each_template_is_found(spark):
    lines = [(i, f"x {line.upper()}, y", "en", "s", 0) for i, (_, _, line) in enumerate(licenses.TEMPLATES)]
    lines += [(100 + i, " ".join(reversed(line.split())), "en", "s", 0) for i, (_, _, line) in enumerate(licenses.TEMPLATES)]
    lines.append((200, "MİT Key apache licenſe version 2", "en", "s", 0))
    lines.append((201, "under the mit license " * 3000, "en", "s", 0))
    lines.append((202, licenses.MIT.replace("as is", "as it is"), "en", "s", 0))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(lines, SCHEMA)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert label not in got[100 + i].labels.split(",")
    assert got[200].labels == "" and (got[201].n_base, got[201].last_word, got[201].score) == (3000, 11996, 0.8)
    assert got[202].labels == "mit" and 0.5 < got[202].score < 1


# 5: quality.


def quality_brute(text):
    own = [w.decode() for w in words(text)]
    n, chars = len(own), sum(map(len, own))
    lines, seen, dup_lines, dup_chars, full = (text or "").split("\n"), set(), 0, 0, 0
    for line in lines:
        inner = line.encode().split()
        if inner:
            full += 1
            if line in seen:
                dup_lines += 1
                dup_chars += sum(len(w.decode()) for w in inner)
            seen.add(line)
    def inside(k):
        grams = Counter(tuple(own[i : i + k]) for i in range(n - k + 1))
        return {j for i in range(n - k + 1) if grams[tuple(own[i : i + k])] > 1 for j in range(i, i + k)}
    repeat = len(inside(3))
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and 100 * dup_lines <= 30 * full and 100 * dup_chars <= 20 * chars
    kept = kept and all(100 * sum(len(own[j]) for j in inside(k)) <= limit * chars for k, limit in quality.NGRAM_LIMITS.items())
    return n, chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup_lines, repeat, failed, kept


def test_quality(docs, rows, empty):
    got = keyed(quality.measure(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert got == sorted(((r[0], *quality_brute(r[1])) for r in rows), key=str)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(g[-1] for g in got) > 0
    assert quality.measure(empty).count() == 0 and quality.accepted(empty).count() == 0


def test_quality_of_repeats():
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "cé", " ", "  ", "\n", "#"]) for _ in range(rng.randint(0, 260)))
        found = quality.verdict(text.encode())
        assert (*found[:5], found[5], found[6]) == quality_brute(text)


# 6: substrings.


def substring_brute(rows):
    first = {}
    for i, text, *_ in rows:
        own = words(text)
        for s in range(len(own) - 49):
            if i is not None:
                key = tuple(own[s : s + 50])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, text, *_ in rows:
        own = words(text)
        gone = set()
        for s in range(len(own) - 49):
            if i is not None and first[tuple(own[s : s + 50])] < i:
                gone |= set(range(s, s + 50))
        kept = b" ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((i, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent,piece", [(1_000_000, 1 << 19), (0, 60)])
def test_substrings(docs, rows, empty, monkeypatch, sent, piece):
    """Texts sent to or joined, and cut into pieces or not."""
    monkeypatch.setattr(substrings, "SENT", sent)
    monkeypatch.setattr(substrings, "PIECE", piece)
    got = keyed(substrings.removed(docs).withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha")
    assert got == substring_brute(rows) and sum(g[2] for g in got) > 500
    assert substrings.removed(empty).count() == 0


def test_factors_cover_the_documents_and_equal_their_sources(spark, rows):
    """Literals and factors make up each document; a factor stands in its source, whose id is smaller, word for word."""
    own = [r for r in {r[0]: r for r in rows if r[0] is not None}.values()]
    own += [(500 + i, " ".join((own[i][1] or "").split(" ")[10:] + (own[i + 1][1] or "").split(" ")), "en", "s", 0) for i in range(20)]
    text = {r[0]: words(r[1]) for r in own}
    found = {r.doc_id: r.factors for r in substrings.factors(spark.createDataFrame(own, SCHEMA).repartition(3)).collect()}
    assert len(found) > 30 and sum(len(f) for f in found.values()) > len(found)
    for i, parts in found.items():
        rebuilt, place = [], 0
        for f in parts:
            assert f.first >= place and f.words > 0 and f.source < i
            rebuilt += text[i][place : f.first] + text[f.source][f.at : f.at + f.words]
            place = f.first + f.words
        assert rebuilt + text[i][place:] == text[i]


def test_the_parse_is_greedy():
    units = [(0, 11, 7, 100), (11, 5, 7, 111), (5, 40, 3, 0), (90, 1, 7, 190), (90, 1, 2, 0), (92, 1, 2, 2), (200, 1, 1, 5)]
    # Source 7 reaches from 0 to 65 and source 3 from 5 to 94; from there 2 goes on (its window at 91 is missing) to 140 and to 142.
    assert substrings.parse(units) == [(0, 65, 7, 100), (65, 29, 3, 60), (94, 48, 2, 4), (200, 50, 1, 5)]
    rng = random.Random(2)
    for _ in range(300):
        units = [(rng.randrange(120), rng.randint(1, 35), rng.randrange(3), rng.randrange(60)) for _ in range(rng.randint(0, 9))]
        covered = {w for first, count, *_ in units for w in range(first, first + count + 49)}
        got = substrings.parse(units)
        assert sum(f[1] for f in got) == len(covered) and {w for f in got for w in range(f[0], f[0] + f[1])} == covered
        assert all(any(f[2] == u[2] and f[3] - f[0] == u[3] - u[0] and u[0] <= f[0] < u[0] + u[1] + 49 for u in units) for f in got)


def test_substrings_of_repetitive_texts(spark):
    """Few different words, so anchors tie and passages overlap in every way."""
    rng = random.Random(9)
    passages = [" ".join(rng.choice("ab") for _ in range(rng.randint(30, 80))) for _ in range(6)]
    rows = [(rng.randrange(60), " ".join(rng.choice([*passages, "x y z"]) for _ in range(rng.randint(1, 4))), "en", "s", 0) for _ in range(70)]
    rows += [(70 + i, "same " * (45 + i), "en", "s", 0) for i in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert keyed(substrings.removed(frame).withColumn("sha", F.sha2("kept", 256)), "doc_id", "n_words", "n_removed", "sha") == substring_brute(rows)


def test_blocks_at_the_edges_of_chunks(monkeypatch):
    x = np.random.default_rng(1).integers(0, 3, 2000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    hashed, valid = substrings.Hashed(np.stack([x, ~x], axis=1)), np.ones(1951, bool)
    monkeypatch.setattr(substrings, "_CHUNK", 100)
    _, _, _, first, count = substrings.blocks(hashed, valid)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == 1951


# 7: lines.


def lines_brute(rows):
    def host(url):
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
        return m[1].lower() if m else None

    cut = [(i, host(u), [" ".join(x.split()) for x in (t or "").split("\n") if x.strip()]) for i, u, t in rows]
    pages = Counter(h for _, h, _ in cut if h)
    seen = Counter((h, x) for _, h, own in cut if h for x in set(own))
    common = {k for k, n in seen.items() if n >= lines.LEAST and 100 * n > lines.RATIO * pages[k[0]]}
    return sorted(((i, h, pages[h] if h else 0, len(own), sum((h, x) in common for x in own), "\n".join(x for x in own if (h, x) not in common)) for i, h, own in cut), key=str)


def test_lines(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        own = [f"text {rng.randrange(1000)}" for _ in range(rng.randrange(5))] + rng.sample(["Home", "About  us", "Log in\tnow", "rare"], 2) * rng.randint(1, 2)
        rng.shuffle(own)
        rows.append((i, f"https://user@{rng.choice(['a.org', 'B.org:80', 'c.org'])}/p?q={i}", "\n\n".join(own)))
    rows += [(100, None, "Home\nHome"), (101, "no host", "Home"), (102, "http://d.org", "Home\nonly"), (103, "http://a.org/", None), (104, "http://a.org/", ""), (None, "http://a.org", "Home\nx"), (5, *rows[5][1:])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    names = ("page_id", "host", "n_pages", "n_lines", "n_dropped", "kept")
    assert keyed(lines.dedup(frame, html=False), *names) == lines_brute(rows)
    monkeypatch.setattr(lines, "BROADCAST", 0)
    assert keyed(lines.dedup(frame, html=False), *names) == lines_brute(rows)
    assert lines.dedup(frame.limit(0)).count() == 0


def test_lines_of_html(spark):
    page = "<html><head><title>T &amp; t</title><style>p{}</style><script>var a = '<p>';</script></head><body><!-- <p>no --><p>one <b>two</b>\n three<br/>four</p><DIV class='x'>five</DIV></body></html>"
    got = spark.createDataFrame([(1, "http://h", page)], "page_id long, url string, html string")
    assert lines.dedup(got).first().kept == "T &amp; t\none two\nthree\nfour\nfive"


# 8: SimHash.


def simhash_brute(rows, k, bits):
    prints = []
    for _, text, *_ in rows:
        own = [w.lower() for w in words(text)]
        cut = [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] if len(own) > k else [b" ".join(own)] if own else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in cut]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return prints, linked(prints, [r[0] for r in rows], bits)


def linked(prints, ids, bits):
    a = np.array(prints, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= bits
    label = np.arange(len(a))
    while True:
        least = np.where(near, label[None, :], len(a)).min(axis=1)
        if (least == label).all():
            break
        label = least
    least = {}
    for i, c in zip(ids, label.tolist(), strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [least.get(c) for c in label.tolist()]


def test_simhash(docs, rows, empty, monkeypatch):
    prints, component = simhash_brute(rows, 3, 2)
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, component, strict=True)), key=str)
    assert keyed(simhash.groups(docs, k=3, bits=2).withColumn("f", simhash.hex_of("fp0")), "doc_id", "f", "component_id") == want
    monkeypatch.setattr(simhash, "BROADCAST", 0)
    monkeypatch.setattr(simhash, "STRETCH", 7)
    monkeypatch.setattr(components, "FOLD", 0)
    assert keyed(simhash.groups(docs, k=3, bits=2).withColumn("f", simhash.hex_of("fp0")), "doc_id", "f", "component_id") == want
    assert simhash.groups(empty).count() == 0


def test_shingles_of_awkward_spaces(monkeypatch):
    rng = random.Random(4)
    for stretch in (1, 3, 1 << 16):
        monkeypatch.setattr(simhash, "STRETCH", stretch)
        for _ in range(200):
            text = "".join(rng.choice("aB \n\t\x0b\x1cé") for _ in range(rng.randint(0, 30))).encode()
            own = text.lower().split()
            want = [b" ".join(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) > 3 else [b" ".join(own)] if own else []
            got = [h for part in simhash.shingle_hashes(text, 3) for h in part.tolist()]
            assert got == [xxhash.xxh64_intdigest(x, 42) for x in want]


@pytest.mark.parametrize("bucket,bits", [(2048, 2), (2048, 3), (8, 2), (40, 3)])
def test_links_lose_nothing_in_crowded_buckets(spark, monkeypatch, bucket, bits):
    """Clusters of fingerprints that share most bits; a small bucket sends them through the further cuts."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bits)
    prints = {0, (1 << 64) - 1}
    for centre in [rng.getrandbits(64) for _ in range(6)]:
        free = rng.sample(range(64), 9)
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in free if rng.random() < 0.3))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(s,) for s in signed], "node long").repartition(3)
    found = components.roots(simhash.links(nodes, bits))
    root = {r.node: r.root for r in found.collect()}
    got = [root.get(s, s) for s in signed]
    want = linked(prints, list(range(len(prints))), bits)
    pairs = lambda labels: {tuple(j for j, y in enumerate(labels) if y == x) for x in labels}
    assert pairs(got) == pairs(want)


@pytest.mark.parametrize("fold", [100_000, 0])
def test_components_of_paths_and_stars(spark, monkeypatch, fold):
    monkeypatch.setattr(components, "FOLD", fold)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 300)] + [(500 + i, 500 + j) for i in range(8) for j in range(i)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + [(7, 7)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 300)}, **{500 + i: 500 for i in range(1, 8)}}
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


# 8 by the similarity of shingles.


def near_sets(rows):
    memo = near._Hashes()
    return [near.shingled((t or "").encode(), memo) for _, t, *_ in rows]


def near_links(rows, sets=None):
    """Every pair that shares a band and verifies, by looking at every pair."""
    sets = sets or near_sets(rows)
    cut, prints = [near.bands(h) for h in sets], np.array([np.frombuffer(near.sketch(h), np.uint64) for h in sets])
    return [(i, j) for i in range(len(sets)) for j in range(i) if any(x == y for x, y in zip(cut[i], cut[j], strict=True)) and near.similar(prints[i], prints[j], 0.8 - near.SLACK)]


def near_components(rows, pairs):
    label = list(range(len(rows)))
    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, j in pairs:
        i, j = top(i), top(j)
        label[max(i, j)] = min(i, j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(top(i), []).append(r)
    return list(out.values())


def near_first(group):
    return min(group, key=lambda r: (r[0] is None, r[0] or 0, r[-1]))


@pytest.fixture(scope="module")
def near_rows(rows):
    rng, out = random.Random(17), [r for r in rows]
    for g in range(12):  # families of copies with more and more edits
        text = prose(rng, 150, 400).split()
        for i in range(8):
            own = text.copy()
            for _ in range(i * 2):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10_000)}"
            out.append((1000 + g * 10 + i, " ".join(own), "en", "s", 0))
    out += [(None, out[-1][1], "en", "s", 0), (2000, None, "en", "s", 0), (2000, "a clean text under an id that a copy shares", "en", "s", 0)]
    return out


@pytest.mark.parametrize("bucket,broadcast", [(2048, 500_000), (4, 500_000), (2, 0)])
def test_near_groups(spark, near_rows, empty, monkeypatch, bucket, broadcast):
    """Brute-force components, whatever the size of a bucket; nulls, empty and long texts, repeated rows, shared ids."""
    want = near_components(near_rows, near_links(near_rows))
    monkeypatch.setattr(near, "BUCKET", bucket)
    monkeypatch.setattr(near, "BROADCAST", broadcast)
    frame = spark.createDataFrame([(*r, "x", 1) for r in near_rows], SCHEMA + ", stamp string, first int").repartition(5)
    got = near.groups(frame)
    least = lambda group: min((r[0] for r in group if r[0] is not None), default=None)
    assert keyed(got, "doc_id", "component_id") == sorted(((r[0], least(g)) for g in want for r in g), key=str)
    kept = near.survivors(frame)
    assert kept.columns == frame.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert len(texts) == len(want)
    assert all(n == sum((r[0], r[1]) == k for r in near_rows) for k, n in texts.items())
    assert all(sum((r[0], r[1]) in texts for r in {x[:2]: x for x in g}.values()) == 1 for g in want)
    assert near.groups(empty).count() == 0 and near.survivors(empty).count() == 0


@pytest.mark.parametrize("n", [2048, 2049, 6144])
def test_a_chain_in_one_bucket(spark, n):
    """Neighbours verify, others don't: one component at any size of the bucket, and two where a link is missing."""
    words = near._WORDS
    chain = np.zeros((n, 2 * words), np.uint64)
    chain[:, :words] = np.uint64((1 << 64) - 1)
    bits = np.zeros((n, 64 * words), np.uint8)
    for i in range(n):
        at = np.arange(i * 90, i * 90 + 180) % (64 * words)  # a window that moves by half its width
        bits[i, at] = 1
    chain[:, words:] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    assert near.similar(chain[:-1], chain[1:], 0.64).all() and not near.similar(chain[:-2], chain[2:], 0.66).any()
    some = [(i, [7], c.tobytes()) for i, c in enumerate(chain)]
    nodes = spark.createDataFrame(some, "node long, bands array<long>, sketch binary").repartition(4)
    got = {r.node: r.root for r in components.roots(near.linked(nodes, 0.64 + near.SLACK)).collect()}
    assert got == {i: 0 for i in range(1, n)}


def test_searching_finds_every_component():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (5, 2 * near._WORDS), np.uint64)
    prints = base[rng.integers(0, 5, 200)]
    prints[:, -1] ^= rng.integers(0, 1 << 20, 200, np.uint64)
    near_by = np.array([near.similar(prints, p, 0.99) for p in prints])
    label = near.searched(prints, 0.99)
    want = np.arange(200)
    while (least := np.where(near_by, want[None, :], 200).min(axis=1)).tolist() != want.tolist():
        want = least
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(200) for j in range(200))


def test_fingerprints_of_sets():
    """Bit by bit, whether it is set in more than half of the weight, whatever the stretch; within three bits a signature is shared."""
    memo, rng = near._Hashes(), random.Random(5)
    for n in (1, 3, 12, 700):
        h = near.shingled(prose(rng, n, 400).encode(), memo)
        bits, want = near._mixed(h).tolist(), []
        for x, m in near._MIX.T.tolist():
            t = [max(((v ^ x) * m % 2**64 >> 32) * len(h) / 2**32, 2) for v in h.tolist()]
            weight = [int(2**40 / (a * a**0.5)) for a in t]
            want.append(sum(1 << b for b in range(64) if 2 * sum(w for w, v in zip(weight, bits, strict=True) if v >> b & 1) > sum(weight)))
        assert near.fingerprints(h).tolist() == want and len(set(want)) == (near.PRINTS if n > 100 else len(set(want)))
    assert near.fingerprints(np.zeros(0, np.uint64)).tolist() == [0] * near.PRINTS
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert (np.uint64(a) & near._MASKS == np.uint64(b) & near._MASKS).any()


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_buckets_hold_every_row(limit):
    """The last bucket of a partition too."""
    sig, node = np.array([1, 1, 2, 3, 3, 3, 3, 9, 9]), np.arange(9)
    for step in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_arrays([pa.array(sig[s : s + step]), pa.array(node[s : s + step])], names=["sig", "node"]) for s in range(0, 9, step)]
        got = list(simhash.buckets(iter(batches), limit))
        assert np.concatenate([x for x, _ in got]).tolist() == sig.tolist() and np.concatenate([x for _, x in got]).tolist() == node.tolist()


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_candidates_meet_by_signatures(spark, monkeypatch, held):
    """Two nodes meet just if a segment has one half equal and the other joined by values that agree but for a bit; by looking at every pair."""
    monkeypatch.setattr(near, "HELD", held)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = []
    for i in range(120):
        own = []
        for p in range(2):
            x = base[(i + p) % 4] ^ (rng.getrandbits(32) << 32 * rng.randrange(2) if i % 3 else 0)
            for bit in rng.sample(range(64), rng.randrange(5)):
                x ^= 1 << bit
            own.append(x)
        prints.append(own)
    want = set()
    for p in range(2):
        for q in range(4):
            groups = {}
            for i, own in enumerate(prints):
                groups.setdefault(own[p] >> 16 * q & 0xFFFF, []).append((i, own[p] >> 16 * (q ^ 1) & 0xFFFF))
            for rows in groups.values():
                joined = linked([r for _, r in rows], list(range(len(rows))), 1)
                want |= {(i, j) for (i, _), x in zip(rows, joined, strict=True) for (j, _), y in zip(rows, joined, strict=True) if i < j and x == y}
    signed = [(i, [x - (1 << 64) if x >> 63 else x for x in own]) for i, own in enumerate(prints)]
    found = near.candidates(spark.createDataFrame(signed, "node long, prints array<long>").repartition(4)).collect()
    buckets = {}
    for r in found:
        buckets.setdefault(r.sig, set()).add(r.node)
    got = {(i, j) for b in buckets.values() for i in b for j in b if i < j}
    assert got == want and 100 < len(want) < 120 * 119 / 2
    # Every pair within three bits in a fingerprint is among them.
    assert {(i, j) for i in range(120) for j in range(i + 1, 120) if any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i], prints[j], strict=True))} <= got


def recall_by_band(pairs_of_texts):
    """Of pairs by their exact similarity in steps of 0.05: how many there are, and the share that is linked."""
    memo, found = near._Hashes(), {}
    for a, b in pairs_of_texts:
        x, y = near.shingled(a.encode(), memo), near.shingled(b.encode(), memo)
        s = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        hit = any(p == q for p, q in zip(near.bands(x), near.bands(y), strict=True))
        hit = hit and bool(near.similar(*(np.frombuffer(near.sketch(h), np.uint64) for h in (x, y)), 0.8 - near.SLACK))
        found.setdefault(min(int(s * 20 + 1e-9), 19), []).append(hit)
    return {k / 20: (len(v), sum(v) / len(v)) for k, v in sorted(found.items())}


def test_recall_after_verification():
    """Scattered edits, a passage of another text appended, the tail cut off: at least 0.9 of the pairs in each band from 0.8 on, few below 0.75."""
    rng, pairs = random.Random(21), []
    for i in range(1500):
        text = prose(rng, rng.randint(80, 900), 400).split()
        n, kind, copy = len(text), i % 3, text.copy()
        if kind == 0:
            for _ in range(max(1, int(n * rng.uniform(0.002, 0.05)))):
                copy[rng.randrange(n)] = f"edit{rng.randrange(10 ** 6)}"
        elif kind == 1:
            copy += prose(rng, int(n * rng.uniform(0.02, 0.3)), 400).split()
        else:
            copy = copy[: n - int(n * rng.uniform(0.02, 0.25))]
        pairs.append((" ".join(text), " ".join(copy)))
    bands = recall_by_band(pairs)
    print(bands)
    assert all(bands[b][0] >= 50 and bands[b][1] >= 0.9 for b in (0.8, 0.85, 0.9, 0.95))
    assert all(share <= 0.1 for b, (_, share) in bands.items() if b < 0.75)


# 9: mixing.


def test_mixing_matches_sql(spark, docs, rows, tmp_path):
    named = docs.drop("row", "norm", "first")
    named.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted((tuple(r) for r in con.sql("SELECT doc_id, domain, lang, source, n_tokens, epoch FROM (" + mixing.MIX_SQL.strip() + ")").fetchall()), key=str)
    got = keyed(mixing.select(named, mixing.documents_mix()), "doc_id", "domain", "lang", "source", "n_tokens", "epoch")
    assert got == want and got


def test_levels_with_names_of_the_plan_raise(docs):
    with pytest.raises(ValueError, match="weight"):
        mixing.select(docs, mixing.Mix(levels={"weight": F.col("lang")}))


def test_ranges_change_nothing(docs, monkeypatch):
    whole = keyed(mixing.select(docs, mixing.documents_mix()), "doc_id", "epoch")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    assert keyed(mixing.select(docs, mixing.documents_mix()), "doc_id", "epoch") == whole


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    supply = spark.createDataFrame([(*r, 1) for r in rows], "top string, leaf string, tokens long, n_rows long")
    mix = mixing.Mix(levels={"top": F.col("top"), "leaf": F.col("leaf")}, budget=400, epochs=1)
    got = {(r.top, r.leaf): r.target for r in mixing.allocate(supply, mix).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    mix.budget = 2500
    got = {(r.top, r.leaf): r.target for r in mixing.allocate(supply, mix).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 745, ("b", "y"): 745}
    mix.budget, mix.weights = 100, {("a",): 0, ("b", "x"): 3}
    assert {(r.top, r.leaf): r.target for r in mixing.allocate(supply, mix).collect()} == {("b", "x"): 75, ("b", "y"): 25}


def test_mixed_rows_keep_their_columns(docs, empty):
    mix = mixing.documents_mix(percent=300)
    got = mixing.selected(docs, mix)
    assert got.columns == docs.columns and got.count() == mixing.select(docs, mix).count() > docs.count()
    assert mixing.select(empty, mix).count() == 0


# 10: languages.


def test_languages(spark, empty):
    rng = random.Random(3)
    stems = {"aa": "abcdeklm", "bb": "nopqrstu", "cc": "ßéñcdopq"}
    rows = [(i, " ".join("".join(rng.choice(stems[x]) for _ in range(5)) for _ in range(60)), x, "s", 0) for i in range(120) for x in [sorted(stems)[i % 3]]]
    rows += [(200, None, "aa", "s", 0), (201, "12 ٣ ²", "aa", "s", 0), (202, "nopq rstu", None, "s", 0), (None, "abcd", "aa", "s", 0), (203, "", "bb", "s", 0)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].lang_pred == x for i, _, x, *_ in rows[:120])
    assert [got[i].lang_pred for i in (200, 201, 203)] == ["und"] * 3 and got[200].score == 0 and got[202].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 3 == 1) for i, r in got.items())
    assert langid.identify(empty).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc", None, "s", 0)], SCHEMA)).first().lang_pred == "und"


def test_the_distance_is_out_of_place():
    profiles = langid.Profiles({"a": np.array([3, 1, 2]), "b": np.array([1, 9])}, size=4)
    assert profiles.nearest(np.array([1, 2])) == ("a", 1 - (1 + 1) / 8)  # b's distance is 0 + 4
    assert profiles.nearest(np.array([9, 1])) == ("b", 1 - (1 + 1) / 8) and profiles.nearest(np.array([5, 6])) == ("a", 0.0)  # a tie goes to the first by name
    assert profiles.nearest(np.array([1]))[0] == "b" and profiles.nearest(np.array([], np.int64)) == ("und", 0.0)


def test_languages_of_long_repeated_and_clashing_rows(spark, monkeypatch):
    rng = random.Random(4)
    long = " ".join("".join(rng.choice("nopqrstuΣσ'") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    rows = [(1, long, "bb", 1, "x"), (1, long, "bb", 1, "x"), (2, "abcd klm", "aa", 2, None), (3, "Z" * 5000, None, 3, "y"), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out int, score string")
    whole = keyed(langid.identify(frame), "doc_id", "held_out", "lang_pred", "score")
    counts = [langid.counted(langid.spaced(t)) for _, t, *_ in rows[:4]]
    monkeypatch.setattr(langid, "PIECE", 50)
    assert all((x == y).all() for c, (_, t, *_) in zip(counts, rows, strict=False) for x, y in zip(c, langid.counts_of(t), strict=True))
    assert keyed(langid.identify(frame), "doc_id", "held_out", "lang_pred", "score") == whole and whole.count(whole[0]) == 2


def test_grams_of_words():
    rng = random.Random(1)
    for _ in range(50):
        own = ["".join(rng.choice("abé漢") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 6))]
        want = Counter(f" {w} "[i : i + n] for w in own for n in (1, 2, 3) for i in range(len(w) + 3 - n))
        del want[" "]
        found, counts = langid.counted(langid.spaced("1 ² _" + "² ".join(own) + "!"))
        names = ["".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0)).rstrip("\0") for g in found.tolist()]
        if "²" not in "".join(names):
            assert dict(zip(names, counts.tolist(), strict=True)) == want
    assert langid.spaced(" 12 ²³ ٣") == "" and langid.spaced("A1b") == " a b "
