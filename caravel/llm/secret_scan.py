"""Secret scans with one combined deterministic automaton.

The whole patterns of all rules are compiled together (subset construction, minimisation)
into one transition array over UTF-8 bytes. It is entered where a match can start, and tells
for all rules at once where their longest match from there ends. Where a match can start
is found by a second combined array, which reads the text once, backwards: an accepting state at byte p
names the rules that can start at p. Rules whose tokens begin with a fixed text take part in
that one with this text, the others with their whole pattern. (One array that finds whole matches
anywhere would have to count all runs of characters at once: even with every bounded repeat loosened to
one or more it has 38,575 states. The pair has 1,432 and 2,528.)

Two runs of the forward array that are in the same state at a byte go on alike, so a run ends where it
meets an earlier one and takes over what that found. Runs differ only while they count repeats, so the
work is linear in the text, also where a text is full of beginnings that come to nothing. Beside the three base
rules there are public formats of vendors' tokens, private keys and addresses with passwords. Nothing is shuffled; the
tables are a few MB whatever the input is, and travel in a broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import Dfa, compile_rules
from .common import tidy, without


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; ``group`` of ``check`` must have ``least`` characters. Every match begins with ``head``, if there is one.

    ``check`` is an ordinary regular expression for exactly the same spans, used to
    measure a group of a span that is already found.
    """

    kind: str
    pattern: str
    check: str | None = None
    group: int = 0
    least: int = 0
    head: str | None = None


def _literal(text: str) -> str:
    """A pattern for exactly this text."""
    return "".join(c if c.isalnum() or c in "_-:/ " else f"\\{c}" for c in text)


# The three base rules. A run of 32 or more hex digits, and AKIA with
# 12 or more characters behind it, are what is left of the open-ended runs once the
# short ones are dropped, so the minimum is part of the pattern there.
_KEY = "password|passwd|secret|token|api_?key"
_REST = "[\"']?\\x20*[:=]\\x20*[\"']?"
BASE_RULES = (
    Rule("assign", f"(?i:{_KEY}){_REST}[A-Za-z0-9+/_.=-]+", f"(?i:({_KEY})){_REST}([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
# Public formats of tokens, as (kind, text that they begin with, pattern of what follows it).
_FORMATS = (
    ("private_key", "-----BEGIN ", "((RSA|EC|DSA|OPENSSH|ENCRYPTED) )?PRIVATE KEY-----"),
    ("pgp_key", "-----BEGIN PGP ", "PRIVATE KEY BLOCK-----"),
    ("jwt", "eyJ", "[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    ("aws_temporary", "ASIA", "[A-Z0-9]{16}"),
    ("github_personal", "ghp_", "[A-Za-z0-9]{36}"),
    ("github_oauth", "gho_", "[A-Za-z0-9]{36}"),
    ("github_user", "ghu_", "[A-Za-z0-9]{36}"),
    ("github_server", "ghs_", "[A-Za-z0-9]{36}"),
    ("github_refresh", "ghr_", "[A-Za-z0-9]{36}"),
    ("github_fine", "github_pat_", "[A-Za-z0-9_]{82}"),
    ("gitlab_personal", "glpat-", "[A-Za-z0-9_-]{20}"),
    ("gitlab_deploy", "gldt-", "[A-Za-z0-9_-]{20}"),
    ("gitlab_runner", "glrt-", "[A-Za-z0-9_-]{20}"),
    ("gitlab_trigger", "glptt-", "[0-9a-f]{40}"),
    ("slack_bot", "xoxb-", "[A-Za-z0-9-]{10,}"),
    ("slack_user", "xoxp-", "[A-Za-z0-9-]{10,}"),
    ("slack_app", "xapp-", "[0-9]-[A-Z0-9]+-[0-9]+-[a-z0-9]+"),
    ("slack_refresh", "xoxr-", "[A-Za-z0-9-]{10,}"),
    ("slack_hook", "https://hooks.slack.com/services/", "T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{24}"),
    ("stripe_live", "sk_live_", "[A-Za-z0-9]{24,}"),
    ("stripe_test", "sk_test_", "[A-Za-z0-9]{24,}"),
    ("stripe_restricted", "rk_live_", "[A-Za-z0-9]{24,}"),
    ("stripe_hook", "whsec_", "[A-Za-z0-9]{32,}"),
    ("google_api", "AIza", "[A-Za-z0-9_-]{35}"),
    ("google_oauth", "ya29.", "[A-Za-z0-9_-]{20,}"),
    ("google_client", "GOCSPX-", "[A-Za-z0-9_-]{28}"),
    ("sendgrid", "SG.", "[A-Za-z0-9_-]{22}\\.[A-Za-z0-9_-]{43}"),
    ("mailgun", "key-", "[0-9a-f]{32}"),
    ("npm", "npm_", "[A-Za-z0-9]{36}"),
    ("pypi", "pypi-AgEIcHlwaS5vcmc", "[A-Za-z0-9_-]{50,}"),
    ("rubygems", "rubygems_", "[0-9a-f]{48}"),
    ("docker", "dckr_pat_", "[A-Za-z0-9_-]{27}"),
    ("openai_project", "sk-proj-", "[A-Za-z0-9_-]{40,}"),
    ("hugging_face", "hf_", "[A-Za-z0-9]{34}"),
    ("replicate", "r8_", "[A-Za-z0-9]{37}"),
    ("shopify_access", "shpat_", "[0-9a-fA-F]{32}"),
    ("shopify_secret", "shpss_", "[0-9a-fA-F]{32}"),
    ("shopify_custom", "shpca_", "[0-9a-fA-F]{32}"),
    ("shopify_private", "shppa_", "[0-9a-fA-F]{32}"),
    ("digitalocean_personal", "dop_v1_", "[0-9a-f]{64}"),
    ("digitalocean_oauth", "doo_v1_", "[0-9a-f]{64}"),
    ("databricks", "dapi", "[0-9a-f]{32}"),
    ("linear", "lin_api_", "[A-Za-z0-9]{40}"),
    ("square_access", "sq0atp-", "[A-Za-z0-9_-]{22}"),
    ("square_secret", "sq0csp-", "[A-Za-z0-9_-]{43}"),
    ("new_relic_user", "NRAK-", "[A-Z0-9]{27}"),
    ("new_relic_browser", "NRJS-", "[0-9a-f]{19}"),
    ("grafana_cloud", "glc_", "[A-Za-z0-9+/]{32,}"),
    ("grafana_service", "glsa_", "[A-Za-z0-9]{32}_[0-9a-f]{8}"),
    ("vault", "hvs.", "[A-Za-z0-9_-]{90,}"),
    ("pulumi", "pul-", "[0-9a-f]{40}"),
    ("postman", "PMAK-", "[0-9a-f]{24}-[0-9a-f]{34}"),
    ("planetscale", "pscale_tkn_", "[A-Za-z0-9_.-]{43}"),
    ("doppler", "dp.pt.", "[A-Za-z0-9]{43}"),
    ("easypost", "EZAK", "[A-Za-z0-9]{54}"),
    ("brevo", "xkeysib-", "[0-9a-f]{64}-[A-Za-z0-9]{16}"),
    ("age", "AGE-SECRET-KEY-1", "[0-9A-Z]{58}"),
    ("postgres_address", "postgres://", "[A-Za-z0-9_.-]+:[A-Za-z0-9_.!%-]+@[A-Za-z0-9.-]+"),
    ("mysql_address", "mysql://", "[A-Za-z0-9_.-]+:[A-Za-z0-9_.!%-]+@[A-Za-z0-9.-]+"),
    ("mongodb_address", "mongodb://", "[A-Za-z0-9_.-]+:[A-Za-z0-9_.!%-]+@[A-Za-z0-9.-]+"),
    ("amqp_address", "amqp://", "[A-Za-z0-9_.-]+:[A-Za-z0-9_.!%-]+@[A-Za-z0-9.-]+"),
    ("web_address", "https://", "[A-Za-z0-9_.-]+:[A-Za-z0-9_.!%-]+@[A-Za-z0-9.-]+"),
)
FORMAT_RULES = tuple(Rule(kind, _literal(head) + rest, head=_literal(head)) for kind, head, rest in _FORMATS)
RULES = (*BASE_RULES, *FORMAT_RULES)
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.starts = compile_rules([r.head or r.pattern for r in rules], backwards=True, anywhere=True)
        self.whole = compile_rules([r.pattern for r in rules])
        self.bits = {m: [n for n in range(len(rules)) if m >> n & 1] for m in self.whole.tags.values()}
        self.checks = [re.compile(r.check, re.ASCII) if r.check else None for r in rules]

    def starting(self, data: bytes) -> list[tuple[int, int]]:
        """(byte, rules that have a match from there), ascending: the one pass."""
        dfa: Dfa = self.starts
        table, accepting, tags, s = dfa.table, dfa.accepting, dfa.tags, dfa.start
        found = []
        at = reversed(data)
        for b in at:
            s = table[s + b]
            if s >= accepting:
                found.append((at.__length_hint__(), tags[s]))
        found.reverse()
        return found

    def runner(self, data: bytes) -> Callable[[int], dict[int, int]]:
        """A function from a byte to {rule: end of its longest match from there}."""
        dfa, bits = self.whole, self.bits
        table, accepting, dead, tags = dfa.table, dfa.accepting, dfa.dead, dfa.tags
        met: dict[int, tuple[int, dict[int, int]]] = {}  # state behind a byte, and what that run found
        low = 0

        def ends(start: int) -> dict[int, int]:
            nonlocal low
            for i in range(low, start if met else low):
                met.pop(i, None)  # starts ascend
            low = start
            s, found, own = dfa.start, {}, []
            for i in range(start, len(data)):
                s = table[s + data[i]]
                if s == dead:
                    break
                if s >= accepting:
                    for n in bits[tags[s]]:
                        found[n] = i + 1
                if (before := met.get(i)) is not None and before[0] == s:
                    for n, end in before[1].items():
                        if end > i:
                            found[n] = end
                    break
                own.append(s)
            for i, s in enumerate(own, start):
                met[i] = (s, found)
            return found

        return ends

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then in the order of the rules."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        hits = self.starting(data)
        if not hits:
            return []
        found = []
        behind = [0] * len(self.rules)
        ends = self.runner(data)
        for start, mask in hits:
            longest = None
            while mask:
                n = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if start < behind[n]:
                    continue
                if longest is None:
                    longest = ends(start)
                end = longest.get(n)
                if end is None:
                    continue
                behind[n] = end
                rule = self.rules[n]
                if rule.least:
                    m = self.checks[n].fullmatch(data[start:end].decode("utf-8", "replace"))
                    if m is None or len(m[rule.group]) < rule.least:
                        continue
                found.append((start, n, end))
        found.sort()
        if len(data) == len(text):
            return [(self.rules[n].kind, a, b) for a, n, b in found]
        place, points, last = {}, 0, 0
        for x in sorted({x for a, _, b in found for x in (a, b)}):
            points += len(data[last:x].decode("utf-8", "surrogatepass"))
            place[x] = points
            last = x
        return [(self.rules[n].kind, place[a], place[b]) for a, n, b in found]


def find_secrets(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """Adds ``out``: array of (kind, start, end), leftmost non-overlapping per kind.

    Ends are exclusive and count code points; spans of different kinds may overlap.
    Null and empty texts get an empty array, an empty table stays empty, repeated rows
    are scanned alike, and a column already called ``out`` is replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(Scanner(rules))

    @F.arrow_udf(T.ArrayType(SPAN))
    @tidy
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spans = shared.value.spans
        for batch in texts:
            found = []
            for i in range(0, len(batch), 256):
                found += [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.slice(i, 256).to_pylist()]
            yield pa.array(found, pa.list_(_SPAN))

    return without(df, [out], (text_col,)).withColumn(out, scan(F.col(f"`{text_col}`").cast("string")))


def mask_text(text_col: str, secrets: str, mark: str = "[SECRET]"):
    """The text with every span that ``secrets`` covers replaced by ``mark``, once for spans that touch or overlap."""
    t, spans = F.col(f"`{text_col}`"), F.col(f"`{secrets}`")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        done = F.when(fresh, F.concat(acc["done"], gap, F.lit(mark))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substr(t, (acc["at"] + 1).cast("int"), F.length(t))))
    return F.when(F.size(spans) > 0, whole).otherwise(t)


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: counts and digests of the spans in ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def brute_spans(text: str | None, more: bool = True) -> list[tuple[str, int, int]]:
    """The spans by regular expressions one after another (for tests); without ``more`` the contract's base spans only."""
    kinds = [("assign", f"(?i:({_KEY})){_REST}([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 32)]
    if more:
        kinds += [(r.kind, r.pattern, lambda m: True) for r in FORMAT_RULES]
    found = [(m.start(), n, m.end()) for n, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return [(kinds[n][0], a, b) for a, n, b in sorted(found)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def _kind_sql(order: int, kind: str, pattern: str, keep: str, group: int = 0) -> str:
    """Spans of one kind: the text between the matches tells where each match begins."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS a, length(m) AS n, {keep} AS keep FROM (
  SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m, unnest(gs) AS g, unnest(gaps[1:len(ms)]) AS gap FROM (
    SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS gaps FROM docs) WHERE len(ms) > 0)"""


SECRETS_SQL = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (
{_kind_sql(0, "assign", f"(?i:({_KEY})){_REST}([A-Za-z0-9+/_.=-]+)", "length(g) >= 8", 2)}
UNION ALL {_kind_sql(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16")}
UNION ALL {_kind_sql(2, "hex", "[0-9a-f]+", "length(m) >= 32")}
{" ".join(f"UNION ALL {_kind_sql(n + 3, r.kind, r.pattern, 'true')}" for n, r in enumerate(FORMAT_RULES))}),
f AS (SELECT doc_id, count(*) FILTER (o = 0)::BIGINT AS n_assign, count(*) FILTER (o = 1)::BIGINT AS n_access, count(*) FILTER (o = 2)::BIGINT AS n_hex,
  string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s WHERE keep GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN f USING (doc_id)"""
