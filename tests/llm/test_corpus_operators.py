"""Near-duplicates, chat formatting, media, LM scores, subword coding and the pipeline."""

import hashlib
import math
import random
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caravel.llm import chat_format, common, lm_score, media, near_dedup, subword
from caravel.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
MODEL = common.read_bytes(common.tokenizer_path("piece_bpe_32k.model"))


def components(texts, threshold=0.8):
    """Class (least id) of each text by comparing every pair that shares a shingle."""
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = defaultdict(set)
    for d, t in texts.items():
        near = set()
        for g in near_dedup._bag.__wrapped__(t or "", 5):
            near |= seen[g]
            seen[g].add(d)
        for e in near:
            if near_dedup.similarity(texts[d], texts[e]) >= threshold:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def test_dart_estimates():
    random.seed(1)
    words = [f"w{i}" for i in range(300)]

    def sketch(ws):
        h = near_dedup.word_hashes([" ".join(ws)])[0]
        return near_dedup.dart_minhash(*np.unique(near_dedup.shingles_of(h, 5), return_counts=True), 3000)

    for edits, repeats in ((1, 0), (4, 0), (4, 15), (25, 0)):
        a = [random.choice(words) for _ in range(120)] + "x y z u v w".split() * repeats
        b = list(a)
        for _ in range(edits):
            b[random.randrange(len(b))] = "zz"
        assert abs((sketch(a) == sketch(b)).mean() - near_dedup.similarity(" ".join(a), " ".join(b))) < 0.04


def test_classes_equal_brute_force(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(400)]
    texts, n = {}, 0
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.choice([3, 40, 90]))]
        for _ in range(random.randint(1, 12)):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                copy[random.randrange(len(copy))] = random.choice(words)
            texts[n] = " ".join(copy)
            n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = components(texts)
    for d, t in texts.items():  # texts of fewer than five words only equal their copies
        if len(t.split()) < 5:
            want[d] = min(e for e, u in texts.items() if u == t)
    got = {r["doc_id"]: (r["class_id"], r["class_rows"]) for r in near_dedup.near_duplicates(df).collect()}
    sizes = Counter(want.values())
    assert got == {d: (c, sizes[c]) for d, c in want.items()}
    kept = near_dedup.keep_one(df.withColumn("class_id", F.lit("own"))).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values())) and kept[0]["class_id"] == "own"


def test_pairs_in_a_large_group_of_less_alike_texts(spark):
    random.seed(3)
    fresh = (f"v{i}" for i in range(100_000))
    base = [next(fresh) for _ in range(176)]
    own = [[next(fresh) for _ in range(24)] for _ in range(240)]
    for i in range(0, 40, 2):  # 20 pairs of similarity 0.83 among 240 texts that are otherwise 0.78 alike
        own[i + 1][:6] = own[i][:6]
    texts = {i: " ".join(base + w) for i, w in enumerate(own)}
    assert 0.77 < near_dedup.similarity(texts[0], texts[2]) < 0.8 < near_dedup.similarity(texts[0], texts[1])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == components(texts)


def test_pairs_that_share_bands_but_no_pair_of_near_bands(spark):
    random.seed(8)
    fresh, s = (f"u{i}" for i in range(1_000_000)), near_dedup.Settings()
    base = [next(fresh) for _ in range(176)]

    def met(a, b):
        x, y = (near_dedup.band_hashes(w, s) for w in near_dedup.word_hashes([a, b]))
        same = x == y
        return same.any() and not any(same[i] and same[(i + d) % s.bands] for i in range(s.bands) for d in (1, 2))

    pairs = []
    while len(pairs) < 12:  # similarity 0.81, as rare as the draws make it
        own = [next(fresh) for _ in range(24)]
        a, b = " ".join(base + own), " ".join(base + own[:5] + [next(fresh) for _ in range(19)])
        if met(a, b):
            pairs.append((a, b))
    texts = dict(enumerate([t for p in pairs for t in p] + [" ".join(base + [next(fresh) for _ in range(24)]) for _ in range(60)]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()} == components(texts)


def test_profiles_bound_the_similarity():
    random.seed(6)
    for _ in range(60):
        a = [random.choice("abcdefgh") for _ in range(random.randint(5, 400))] + ["x"] * random.choice([0, 0, 700])
        b = [random.choice("abcdefgh") if random.random() < 0.1 else w for w in a][: random.randint(5, len(a))] + ["x"] * random.choice([0, 600])
        p, q = (np.frombuffer(near_dedup.profile(w, 5), np.uint8)[None, :] for w in near_dedup.word_hashes([" ".join(a), " ".join(b)]))
        assert near_dedup.most_similar(p, q)[0] >= near_dedup.similarity(" ".join(a), " ".join(b))


def test_rest_pairs_equal_all_pairs(spark):
    """Buckets in one part and in many give the pairs that a loop over all pairs of a bucket gives."""
    random.seed(9)
    rows = []
    for h in (5, -7, 9):
        base = [random.choice("abcdefghijklmnop") for _ in range(60)]
        for k in range(30):
            words = [random.choice("abcdefghijklmnop") if random.random() < 0.04 else w for w in base]
            rows.append((h, h * 100 + k, k // 3, near_dedup.profile(near_dedup.word_hashes([" ".join(words)])[0], 5)))
    want = set()
    for h, a, x, p in rows:
        for g, b, y, q in rows:
            near = near_dedup.most_similar(*(np.frombuffer(r, np.uint8)[None, :] for r in (p, q)))[0]
            if h == g and a < b and x != y and near >= 0.8:
                want.add((a, b))
    df = spark.createDataFrame([(h, k, x, bytearray(p)) for h, k, x, p in rows], "h long, key long, label long, profile binary")
    for part in (256, 7):
        assert {tuple(r) for r in near_dedup._rest_pairs(df, 0.8, part).collect()} == want
    assert 20 < len(want) < 1200


def test_dedup_odd_rows(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d, e f"), (4, "A b c d, e f"), (5, None), (6, None), (7, ""), (8, ""), (9, "!!"), (10, "x " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["class_id"] or 0, r["class_rows"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, 4, 3), (4, 4, 3), (4, 4, 3), (5, 5, 1), (6, 6, 1), (7, 7, 2), (8, 7, 2), (9, 9, 1), (10, 10, 1)]
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(df).collect()) == [4, 5, 6, 7, 9, 10]
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_chat_prefix(spark):
    turns = lambda rows: chat_format.clean_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    chosen = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "good <|end|>"), (2, 0, "user", "x"), (3, 0, "user", "only"), (5, 0, "user", "a"), (5, 1, "assistant", "b")])
    rejected = turns([(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "more"), (2, 0, "user", "x"), (4, 7, "assistant", "z"), (5, 1, "user", "a"), (5, 2000, "assistant", "b")])
    rows = chat_format.format_preferences(chosen, rejected)
    want = [(1, "chosen", 1, 1, True), (1, "prompt", 0, 0, False), (1, "rejected", 1, 1, True), (1, "rejected", 2, 2, False), (2, "prompt", 0, 0, False), (3, "chosen", 0, 0, False)]
    want += [(4, "rejected", 0, 7, True), (5, "prompt", 0, 0, False), (5, "prompt", 1, 1, False)]  # numbered from 0 and from 1, and all alike
    assert sorted((r["pair_id"], r["part"], r["position"], r["turn"], r["trained"]) for r in rows.collect()) == want
    r = chat_format.assembled(rows).where("pair_id = 1").first()
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\ngood < |end|><|end|>\n"
    assert [tuple(x) for x in r["rejected_mask"]] == [(0, len("<|assistant|>\nbad<|end|>\n"))]


def test_chat_odd_turns(spark):
    df = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, "user", "a", "x"), (1, 1, "assistant", "b", "x"), (1, 1, "assistant", "b", "x"), (None, 0, "user", "c", "x"), (2, None, "user", "d", "x"), (3, 0, "user", "e", "x")], "conv_id long, turn long, role string, text string, block string")
    turns = chat_format.clean_turns(df)
    assert sorted((r["pair_id"], r["turn"], r["role"]) for r in turns.collect()) == [(1, 0, "unknown"), (1, 1, "assistant"), (3, 0, "user")]
    assert sorted((r["pair_id"], r["turn"], r["text"]) for r in chat_format.stale_reply(turns).collect()) == [(1, 0, ""), (1, 1, ""), (3, 0, "e")]
    assert chat_format.format_preferences(turns.where("false"), turns.where("false")).count() == 0


def test_chat_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS", 4)
    rows = [(1, t, "user" if t in (2, 30) else "system" if t != 21 else "assistant", f"t{t}") for t in range(0, 40, 3)] + [(1, 2, "user", "said")]
    turns = chat_format.clean_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.format_preferences(turns, chat_format.stale_reply(turns)).collect()
    order = sorted({r[1] for r in rows})
    assert all(r["position"] == order.index(r["turn"]) for r in got)
    assert {(r["turn"], r["rendered"].split("\n")[1]) for r in got if r["part"] == "rejected" and r["turn"] <= 21} == {(21, "said<|end|>")}
    assert sorted(r["turn"] for r in got if r["part"] != "rejected") == order


def test_chat_without_assistant_is_all_prompt(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "user", "d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((r["pair_id"], r["part"], r["turn"], r["trained"]) for r in chat_format.chat_query(spark, str(tmp_path)).collect())
    assert got == [(1, "chosen", 1, True), (1, "prompt", 0, False), (1, "rejected", 1, True), (2, "prompt", 0, False), (2, "prompt", 1, False)]


def test_chat_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    df = QUERIES["op6_chat_format"](spark, DIR)
    cols = sorted(df.columns)
    found = c.sql(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op6_chat_format']})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(found)


def test_media_round_trip(spark):
    rows = {r["doc_id"]: r for r in media.media_query(spark, DIR).collect()}
    for d, t in common.documents(spark, DIR).select("doc_id", "text").collect():
        data = (t or "").encode()
        payload = media.padded(data)
        assert (rows[d]["n_bytes"], rows[d]["payload_bytes"], rows[d]["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert rows[d]["media_sha256"] == hashlib.sha256(media.to_png(payload, len(data))).hexdigest()


def test_media_odd_rows_and_ranges(spark):
    df = spark.createDataFrame([(None, None), (2, ""), (2, ""), (3, "é" * 100_000)], "doc_id long, text string")
    folder = media.store_texts(df)
    whole = media.read_archives(spark, folder).select("archive", "offset", "key").collect()
    pieces = media.read_archives(spark, folder, rangeBytes=100).select("archive", "offset", "key").collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, pieces)) and len(whole) == 4
    facts = media.media_facts(media.read_archives(spark, folder)).select("key", "facts.*").collect()
    assert sorted((r["key"] or "", r["n_bytes"]) for r in facts) == [("", 0), ("2", 0), ("2", 0), ("3", 200_000)]
    assert media.read_archives(spark, media.store_texts(df.where("false"))).count() == 0


def test_member_retries(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"1" * 50)
        z.writestr("two", b"2" * 50)
    members = zipfile.ZipFile(path).infolist()
    local = media.pafs.LocalFileSystem()

    class Flaky:
        fails = 2

        def open_input_file(self, p):
            if self.fails:
                self.fails -= 1
                raise OSError("lost")
            return local.open_input_file(p)

    assert media.read_member(Flaky(), str(path), members[1], pause=0.0) == b"2" * 50
    data = bytearray(path.read_bytes())
    data[members[0].header_offset + 40] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(OSError, match="damaged"):
        media.read_member(local, str(path), members[0], pause=0.0)
    assert media.read_member(local, str(path), members[1]) == b"2" * 50


def test_lattice_sums_all_segmentations():
    log_p = {"▁": -1.0, "a": -2.0, "b": -1.5, "ab": -2.2, "▁a": -1.1, "ba": -3.0} | {f"<0x{i:02X}>": -5.0 for i in range(256)}
    one = lm_score.Lattice(log_p, -0.5)

    def every(s):
        if not s:
            return 1.0
        total = sum(math.exp(log_p[s[:k]]) * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in log_p)
        return total if s[0] in log_p else math.exp(-5.0 * len(s[0].encode())) * every(s[1:])

    words = ["", "a", "abab", "bé", "a" * 70, "日ab"]
    want = [math.log(every("▁" + w)) if w else -0.5 for w in words[:4]]
    assert np.allclose([one.word(w) for w in words[:4]], want)
    many = lm_score.Lattices(one)
    assert np.allclose(many.marginals(words), [one.word(w) for w in words])
    a, b = many.expected(words[1:], [2, 3, 1, 1, 4]), {}
    for w, n in zip(words[1:], [2, 3, 1, 1, 4], strict=True):
        one.expected(w, n, b)
    assert set(a) == set(b) and all(math.isclose(a[k], b[k], rel_tol=1e-6, abs_tol=1e-6) for k in a)
    assert math.isclose(sum(len(k) * v for k, v in one_expected(one, "abab").items()), 5)


def one_expected(lattice, word):
    out = {}
    lattice.expected(word, 1, out)
    return out


def test_lm_base_equals_brute_force(spark):
    rows = [(1, "A b  a\tb", True), (2, "a zz", False), (3, None, True), (4, "", None), (4, "", None), (5, "q" * 3000 + " a", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    counts = Counter(w for _, t, tr in rows if tr for w in lm_score.tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted(lm_score.score_documents(df, MODEL).collect(), key=lambda r: (r["doc_id"], r["n_tokens"]))
    for r, (d, t, _) in zip(got, rows, strict=True):
        tokens = lm_score.tokens_of(t)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r["score"] < 0
    assert lm_score.score_documents(df.where("false"), MODEL).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_lm_score_equals_enumeration(spark, rounds):
    """The query's score is the sum over all segmentations, whole words included, under the same piece weights."""
    rows = [(1, "ab a  ba", True), (2, "a abc", False), (3, None, True), (4, "ba Ab", True), (5, "é", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    counts = Counter(w.decode() for _, t, tr in rows if tr for w in lm_score.tokens_of(t))
    total = sum(counts.values())
    words = spark.createDataFrame([(w, n, n) for w, n in counts.items()], "word string, n long, n_train long")
    lattice = lm_score.learn_pieces(words, MODEL, rounds)
    assert math.isclose(sum(map(math.exp, lattice.log_p.values())) + math.exp(lattice.end), 1, rel_tol=1e-9)

    def every(s):
        if not s:
            return 1.0
        found = sum(math.exp(lattice.log_p[s[:k]]) * every(s[k:]) for k in range(1, len(s) + 1) if s[:k] in lattice.log_p)
        if s[0] not in lattice.log_p:
            found += math.exp(sum(lattice.log_p[f"<0x{b:02X}>"] for b in s[0].encode())) * every(s[1:])
        return found

    unseen = max(1e-6, min(0.5, sum(n == 1 for n in counts.values()) / total))

    def token(w):
        pieces = every("▁" + w) if w else math.exp(lattice.end)
        return (1 - unseen) * counts[w] / total + unseen * pieces

    found = lm_score.score_documents(df, MODEL, rounds=rounds).collect()
    got, pure = ({r["doc_id"]: r[c] for r in found} for c in ("score", "lattice_score"))
    for d, t, _ in rows:
        assert math.isclose(pure[d], sum(math.log10(every("▁" + w.decode()) if w else math.exp(lattice.end)) for w in lm_score.tokens_of(t)), rel_tol=1e-6)
        assert math.isclose(got[d], sum(math.log10(token(w.decode())) for w in lm_score.tokens_of(t)), rel_tol=1e-6)


def test_vocabulary_scores_follow_the_vocabulary():
    own = lm_score.vocabulary_scores(MODEL)
    v = subword.Vocabulary.load(MODEL)
    pieces = [x for x, _, s in sorted(v.table(), key=lambda r: -r[2]) if x in own]
    assert all(own[a] >= own[b] for a, b in zip(pieces, pieces[1:], strict=False))
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    for n, piece in enumerate(proto.pieces):
        piece.score = -1.0 - n / 1000
    assert sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    unigram = lm_score.vocabulary_scores(proto.SerializeToString())
    a, b = "▁the", "ing"
    at = {p.piece: p.score for p in proto.pieces}
    assert math.isclose(unigram[a] - unigram[b], at[a] - at[b], abs_tol=1e-5)


def test_subword_equals_the_loop_and_the_library(spark):
    v = subword.Vocabulary.load(MODEL)
    coder = subword.Coder(v)
    docs = dict(common.documents(spark, DIR).select("doc_id", "text").collect())
    rows = QUERIES["op10_subword"](spark, DIR).collect()

    known = {}

    def looped(text):
        found = v.segments(text)
        known.update({x: coder.looped(x) for x in found if x not in known})
        return [i for x in found for i in known[x]]

    assert len(rows) == len(docs)
    for r in rows:
        assert r["round_trip"] and (r["piece_ids"] or []) == looped(docs[r["doc_id"]])

    # the library's own best path under the same scores: its model with the kind set to unigram; scores of
    # -1e9 (runs of spaces) are lifted, because beside them its 32-bit sums lose the small ones
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(MODEL)
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    score = lambda ids: sum(v.scores[i] for i in ids)
    checked = 0
    for text in list(docs.values())[:40]:
        for word in set(text.split()):
            ids = library.encode(word)
            if all(v.pieces[i] and not v.pieces[i].startswith("<0x") for i in ids):
                assert score(looped(word)) == score(ids)
                checked += 1
    assert checked > 500


def test_segments_part_where_no_piece_reaches():
    """The best path of a whole text is that of its segments, one after another."""
    random.seed(11)
    v = subword.Vocabulary.load(MODEL)
    known = v.known
    for _ in range(40):
        text = "".join(random.choice(["the", "ing", " ", "  ", ",", "\n", "é", "日本", "▁", "x", "Q", "12", "🙂", "****"]) for _ in range(random.randint(1, 25)))
        whole = subword.best_path((" " + text).replace(" ", "▁"), known, v.longest, v.unknown_score)
        assert "".join(v.segments(text)) == " " + text
        parts = [p for s in v.segments(text) for p in subword.best_path(s.replace(" ", "▁"), known, v.longest, v.unknown_score)]
        score = lambda path: sum(v.scores[i] if i >= 0 else v.unknown_score for _, _, i in path)
        assert math.isclose(score(whole), score(parts))


def test_subword_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  two  spaces \n\nand 日本🙂 "), (3, "  two  spaces \n\nand 日本🙂 "), (None, "x" * 5000), (5, "a"), (6, "aeiou" * 20000 + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece_ids", F.lit(1)).withColumn("block", F.lit("b")).withColumn("rows", F.array(F.lit(1)))
    got = subword.decode(subword.encode(df, MODEL), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["decoded"] == r["text"], r["block"], r["rows"]) for r in got if r["text"] is not None) == [(d, True, "b", [1]) for d in (0, 2, 3, 3, 5, 6)]
    by_id = {r["doc_id"]: r["piece_ids"] for r in got}
    assert by_id[1] is None and by_id[2] == []
    coder = subword.Coder(subword.Vocabulary.load(MODEL))
    assert by_id[None] == [i for s in coder.vocabulary.segments("x" * 5000) for i in coder.looped(s)]
    assert subword.encode(df.where("false"), MODEL).count() == 0


def test_subword_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(subword, "BLOCK_BYTES", 700)
    df = common.documents(spark, DIR).where("doc_id < 60").select("doc_id", "text")
    rows = subword.encode(df, MODEL, round_trip="same", share=1e-3).collect()
    v = subword.Vocabulary.load(MODEL)
    coder, known = subword.Coder(v), {}
    for r in rows:
        found = v.segments(r["text"])
        known.update({x: coder.looped(x) for x in found if x not in known})
        assert r["same"] and (r["piece_ids"] or []) == [i for x in found for i in known[x]]
    assert len(rows) == df.count()


def test_broken_bytes_decode_to_the_replacement_mark(spark):
    byte = subword.Vocabulary.load(MODEL).spelled()
    df = spark.createDataFrame([([byte[0xE6], byte[0x97]],), (None,), ([],)], "piece_ids array<int>")
    assert [r["decoded"] for r in subword.decode(df, MODEL).collect()] == [b"\xe6\x97".decode("utf-8", "replace"), None, ""]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").withColumn("extra", F.lit(1))
    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "pieces"]
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, docs, "/root/testdata/sf0.01"), name)
        if name == "pieces":
            assert out.columns == [*docs.columns, "piece_ids"] and out.count() == docs.count()
            continue
        assert out.columns == docs.columns
        assert out.where(F.length("text") != F.col("n_chars")).count() == 0
        if name == "near_dedup":
            texts = dict(docs.select("doc_id", "text").collect())
            assert {r["doc_id"] for r in out.collect()} == set(components(texts).values())
        if name == "secrets":
            from caravel.llm.secret_scan import brute_spans

            assert not any(brute_spans(r["text"]) for r in out.collect())
        docs = out
