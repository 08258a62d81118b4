"""Secret scan, token counts, language identification, toxicity and decontamination."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from caravel.llm import automaton, common, decontamination, language_id, secret_scan, token_count, toxicity

SCHEMA = "doc_id long, text string, lang string, spans string, secrets int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash."""
    rows = [(1, None, None, "x", 1), (2, "", "en", "x", 1), (3, "token=abcdefgh1 é", "en", "x", 1), (3, "token=abcdefgh1 é", "en", "x", 1), (None, "word " * 30000, "de", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,4}x?", "(?i:ab)+|c.d", "[^a]b{3}", "a\\x20b|(ab|a)(bc)?"])
def test_automaton_equals_re(pattern):
    dfa = automaton.compile_rules([pattern], backwards=True, anywhere=True)
    ends = automaton.compile_rules([pattern])
    random.seed(1)
    for _ in range(400):
        text = "".join(random.choice("abcdxAB ") for _ in range(random.randint(0, 12)))
        data, s, starts = text.encode(), dfa.start, set()
        for i in range(len(data) - 1, -1, -1):
            s = dfa.table[s + data[i]]
            if s >= dfa.accepting:
                starts.add(i)
        assert starts == {i for i in range(len(text)) if any(re.fullmatch(pattern, text[i:j]) for j in range(i + 1, len(text) + 1))}
        for i in starts:
            s, longest = ends.start, None
            for j in range(i, len(data)):
                s = ends.table[s + data[j]]
                if s >= ends.accepting:
                    longest = j + 1
            assert longest == max(j for j in range(i + 1, len(text) + 1) if re.fullmatch(pattern, text[i:j]))


def test_secrets_equal_brute_force():
    random.seed(2)
    parts = ["token", "secret", "api_key", "apikey", "PASSWORD", "'", '"', " ", ":", "=", "abc", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef" * 2, "é", "x.y/+-_", "\n", "ABCDEFGH12345", "a1"]
    scanner = secret_scan.Scanner()
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 20)))
        assert scanner.spans(text) == secret_scan.brute_spans(text)


def test_secret_formats_equal_brute_force():
    """Every public format, whole, cut short by one character and among other text, equals its regular expression."""
    random.seed(12)
    scanner = secret_scan.Scanner()
    assert len(secret_scan.FORMAT_RULES) >= 50

    def made(tree):
        kind = tree[0]
        if kind == "set":
            return chr(random.choice(sorted(c for c in tree[1] if 32 < c < 127) or sorted(tree[1])))
        if kind == "cat":
            return "".join(made(x) for x in tree[1])
        if kind == "alt":
            return made(random.choice(tree[1]))
        n = random.randint(tree[2], tree[3] if tree[3] is not None else tree[2] + 3)
        return "".join(made(tree[1]) for _ in range(n))

    for rule in secret_scan.FORMAT_RULES:
        tree = automaton._Parser(rule.pattern).parse()
        for _ in range(4):
            token = made(tree)
            for text in (token, token[:-1], f"é {token} and {token}", token + token, "x" + token + "-"):
                assert scanner.spans(text) == secret_scan.brute_spans(text), (rule.kind, text)
        assert rule.kind in {k for k, _, _ in scanner.spans(f" {made(tree)} ")}


def test_secrets_query(spark, odd):
    found = secret_scan.find_secrets(odd)
    assert found.columns == ["doc_id", "text", "lang", "spans", "secrets"]
    got = [[tuple(s) for s in r["secrets"]] for r in found.collect()]
    assert got == [[], [], [("assign", 0, 15)], [("assign", 0, 15)], []]
    masked = found.withColumn("m", secret_scan.mask_text("text", "secrets"))
    assert [r["m"] for r in masked.where("doc_id = 3").collect()] == ["[SECRET] é"] * 2
    assert secret_scan.find_secrets(odd.where("false")).count() == 0


def test_secrets_query_whole_table(spark):
    rows = {r["doc_id"]: r for r in secret_scan.secrets_query(spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in common.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect():
        spans = secret_scan.brute_spans(text)
        base = [x for x in spans if x[0] in ("assign", "access", "hex")]
        assert base == secret_scan.brute_spans(text, more=False) and rows[doc_id]["base_sha256"] == secret_scan.digest(base)
        assert rows[doc_id]["n_assign"] + rows[doc_id]["n_access"] + rows[doc_id]["n_hex"] == len(base)


def test_tokens_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_count.BytePairs(common.read_bytes(path))
    random.seed(3)
    parts = ["<|endoftext|>", "  ", "\n\n", "\t", "é", "日本", "don't", "'LL", "123", " the", "🙂", "a" * 60, "%%%", "thndlyan", "\x85"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(2000)]
    assert [own.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [r["n_tokens"] for r in token_count.count_tokens(odd, path).collect()][:2] == [0, 0]
    got = {r["doc_id"]: r["n_tokens"] for r in token_count.token_query(spark, "/root/testdata/sf0.001").collect()}
    docs = common.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text").collect()
    assert got == {d: len(e.ids) for (d, _), e in zip(docs, library.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True)}


def test_language(spark, odd):
    got = language_id.language_query(spark, "/root/testdata/sf0.01")
    truth = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    model = language_id.learn(odd)
    assert set(model.dictionaries) == {"en", "de"}
    rows = language_id.identify(odd, model).collect()
    assert [r["language"]["lang"] for r in rows][:2] == ["und", "und"] and rows[4]["language"]["lang"] == "de"
    empty = language_id.learn(odd.where("false"))
    assert {r["language"]["lang"] for r in language_id.identify(odd, empty).collect()} == {"und"}


def test_toxicity(spark, odd):
    got = toxicity.toxicity_query(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = got.join(labels, "doc_id").where("held_out").collect()
    hits = sum(r["predicted"] and r["toxic"] for r in held)
    assert hits / sum(r["predicted"] for r in held) > 0.95 and hits / sum(r["toxic"] for r in held) > 0.85
    none = toxicity.learn(odd, labels.where("false"))
    scores = [r["toxicity"] for r in toxicity.score_toxicity(odd, none).collect()]
    assert len(scores) == 5 and all(0 <= s < 0.5 for s in scores)


def test_label_model_counts_copies_once():
    import numpy as np

    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.3).astype(float)
    vote = lambda right: ((rng.random(4000) < np.where(y == 1, right, 1 - right))).astype(float)
    a, b, c = vote(0.9), vote(0.8), vote(0.8)
    model = toxicity.LabelModel(np.column_stack([a, b, c, c, c]), y, toxicity.Settings(trust=0.9))
    # the copies hang on each other, and a copy that its parent tells adds nothing
    assert {3, 4} <= {i for i in range(5) if model.parent[i] in (2, 3, 4) and model.parent[i] != i}
    say = np.log(model.on[1, 1] / model.on[0, 1])
    assert abs(say[3]) < 0.05 and abs(say[4]) < 0.05
    assert ((model.posterior > 0.5) == (y == 1)).mean() > 0.95


def test_linear_fit_equals_dense_newton(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "PAIRS", 37)
    rng = np.random.default_rng(3)
    x = (rng.random((200, 6)) < 0.3).astype(np.uint8)
    x[:5] = 0
    target = 1 / (1 + np.exp(-(x @ np.array([2.0, -1, 0.5, 0, 1, -2]) - 0.5)))
    w = toxicity.fit_linear(x, target, 0.3)
    full = np.hstack([x, np.ones((200, 1))]).astype(float)
    p = 1 / (1 + np.exp(-(full @ w)))
    assert np.abs(full.T @ (p - target) + np.array([0.3] * 6 + [1e-3]) * w).max() < 1e-5


def test_label_model_equals_enumeration():
    """The posterior is Bayes' rule over the model's own tables, row by row."""
    import math

    import numpy as np

    rng = np.random.default_rng(4)
    y = (rng.random(500) < 0.4).astype(float)
    votes = np.column_stack([(rng.random(500) < np.where(y == 1, p, q)).astype(float) for p, q in ((0.8, 0.2), (0.6, 0.1), (0.5, 0.4))])
    settings = toxicity.Settings(rounds=400)
    model = toxicity.LabelModel(votes, y, settings)
    post = model.posterior
    told = [((y == 1) @ (1 - post) + 1) / ((1 - post).sum() + 20), ((y == 1) @ post + 19) / (post.sum() + 20)]
    for i in range(0, 500, 25):
        joint = []
        for h in (0, 1):
            prob = post.mean() if h else 1 - post.mean()
            prob *= told[h] if y[i] == 1 else 1 - told[h]
            for j in range(3):
                up = 0 if model.parent[j] == j else int(votes[i, model.parent[j]])
                on = model.on[h, up, j]
                prob *= on if votes[i, j] else 1 - on
            joint.append(prob)
        assert math.isclose(joint[1] / sum(joint), post[i], abs_tol=2e-3)


def test_toxicity_conflicts_and_repeats(spark):
    docs = spark.createDataFrame([(i, ("grim vile " if i % 2 else "calm mild ") + f"word{i}") for i in range(200)] * 2 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(0, 1), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert {"grim", "vile"} <= set(model.lexicon)
    clash = docs.limit(3).withColumn("toxicity", F.lit("own")).withColumn("_toxicity", F.lit(1))
    assert toxicity.score_toxicity(clash, model).columns == ["doc_id", "text", "_toxicity", "toxicity"]
    assert model.score("you grim VILE grim") > 0.5 > model.score("calm") and toxicity.score_toxicity(docs.where("false"), model).count() == 0


def test_leaks_equal_brute_force():
    random.seed(5)
    for n in range(600):
        window, letters = random.choice([2, 3, 4, 10]), "ab" if n % 2 else "abcdé"
        items = [(random.choice([str(i), None, "x"]) if n % 5 == 0 else str(i), " ".join(random.choice(letters) for _ in range(random.randint(0, 9)))) for i in range(random.randint(0, 5))]
        own = decontamination.Automaton(items, window)
        for _ in range(3):
            text = " ".join(random.choice(letters) for _ in range(random.randint(0, 25)))
            words, spans, found = own.scan(text)
            assert (words, {x for s in spans for x in range(*s)}, set(found)) == decontamination.brute_leaks(text, items, window)


def test_long_items_keep_their_windows(spark):
    words = [f"w{i % 37}x{i}" for i in range(400)]
    items = spark.createDataFrame([("long", " ".join(words)), ("short", "a b c")], "item_id string, text string")
    docs = spark.createDataFrame([(i, " ".join(["z", *words[i : i + 10], "z"])) for i in range(0, 391, 7)], "doc_id long, text string")
    for block in (100_000, 64):
        got = decontamination.find_leaks(docs, items, block_words=block).collect()
        assert all([tuple(s) for s in r["leaks"]["spans"]] == [(1, 11)] and r["leaks"]["items"] == ["long"] for r in got)


def test_predictions_equal_a_loop(spark):
    """The query's language is the least total of blocks over freshly made compressors."""
    import zstandard

    docs = common.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(common.fold_of() != 0))
    s = model.settings
    for r in language_id.identify(docs, model).limit(40).collect():
        data = language_id.folded(r["text"])
        if not data:
            assert r["language"]["lang"] == "und"
            continue
        sizes = []
        for n, (lang, raw) in enumerate(model.dictionaries.items()):
            params = zstandard.ZstdCompressionParameters.from_level(s.level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            total = 0
            for i in range(0, len(data), s.block):
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                total += len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data[i : i + s.block]))
            sizes.append((total, n, lang))
        assert min(sizes)[2] == r["language"]["lang"]


@pytest.mark.parametrize("block_words", [500_000, 3])
def test_leaks_in_blocks(spark, odd, block_words):
    items = spark.createDataFrame([("a", "x y z"), ("b", "word " * 12), (None, "p q"), ("c", None), ("d", "")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "p Q r"), (2, "the X y Z end"), (3, None), (4, "x y")], "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["leaks"]["spans"]], r["leaks"]["items"]) for r in decontamination.find_leaks(docs, items, block_words=block_words).collect()}
    assert got == {1: ([(0, 2)], []), 2: ([(1, 4)], ["a"]), 3: ([], []), 4: ([], [])}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, items, span_words=2, max_coverage=0.7, block_words=block_words).collect()}
    assert cut == {1: " r", 2: "the  end", 3: None, 4: "x y"}
    assert decontamination.decontaminate(odd, items, block_words=block_words).count() == 4
    assert decontamination.find_leaks(docs, items.where("false")).where("size(leaks.spans) > 0").count() == 0


def test_leaks_query(spark):
    d = "/root/testdata/sf0.001"
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {r["doc_id"]: r for r in decontamination.leaks_query(spark, d).collect()}
    docs = common.documents(spark, d).where(F.length("text") < 3000).select("doc_id", "text").collect()
    for doc_id, text in docs[:60]:
        n, hit, found = decontamination.brute_leaks(text, items)
        r = got[doc_id]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(found), bool(hit))


def test_secret_scan_is_linear():
    """Texts full of beginnings that come to nothing take time in proportion, and give what the expressions give."""
    import time

    from caravel.llm.secret_scan import Scanner, brute_spans

    scanner = Scanner()
    for unit in ("eyJ", "eyJaaaaaaaa.", "https://a:", "ghp_", "sk_live_AKIA", "token=xoxb-"):
        small = unit * 40
        assert scanner.spans(small) == brute_spans(small)
        took = []
        for n in (4_000, 32_000):
            text = unit * n
            began = time.perf_counter()
            scanner.spans(text)
            took.append(time.perf_counter() - began)
        assert took[1] < 24 * max(took[0], 0.02), (unit, took)


def test_runs_that_meet_find_what_they_would_alone():
    import random

    from caravel.llm.secret_scan import _FORMATS, Scanner, brute_spans

    scanner, r = Scanner(), random.Random(5)
    heads = [head for _, head, _ in _FORMATS] + ["password=", "AKIA", "secret: '", "deadbeef", "PRIVATE KEY-----", ".eyJ", "@", ":"]
    for _ in range(600):
        parts = [r.choice(heads) if r.random() < 0.3 else "".join(r.choice("abcdef0123456789ABCXYZ_-.+/ \u00e9\n") for _ in range(r.choice([1, 5, 12, 20, 36, 40, 64, 90]))) for _ in range(r.randint(1, 9))]
        text = "".join(parts)
        assert scanner.spans(text) == brute_spans(text)
