"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates are credentials (tokens with
a digit, and whatever follows a word such as "password") and numbers that no base pattern took (digit strings that fail a
check, phone numbers without a country). Every candidate, base ones too, gets five votes for, against or neither: from its
format, a gazetteer, its context, its character statistics and its structure. How often each combination of votes and
features occurs in the whole corpus is counted; expectation maximisation over these counts estimates how reliable each
labeler is for each kind, and its posteriors train a logistic span classifier, which sees features of the span and its
surroundings, not the votes. Candidates that it accepts are added; base spans that it rejects are counted as doubtful.
Texts are read once: the spans with their patterns are a small table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, materialize, small_batches

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, but tried once for each run of digits: inside a run no other start can lead further than its first digit does.
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
BASE = ("email", "ip", "card", "phone")
ADDED = ("credential", "number")
LABELERS = ("format", "gazetteer", "context", "statistics", "structure")

#: Candidates beyond the base: tokens with a digit, what stands behind a word for a secret, and digit strings.
TOKEN = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*[0-9])[A-Za-z0-9_/+-]{8,}")
SECRET = re.compile(r"\b(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|auth|bearer)\b[\"']?\s?[=:]\s?[\"']?([^\s\"',;]{6,})", re.I)
NUMBER = re.compile(r"(?<![A-Za-z0-9_])\(?[0-9](?:[().\x20-]{0,2}[0-9]){6,18}(?![0-9A-Za-z_])")

#: Fixed values, the gazetteers: top-level domains beside the two-letter ones, calling codes, card issuers' first digits
#: with their lengths, networks that no person has, first letters of known keys, and words that stand where a secret would.
DOMAINS = frozenset("aero app arpa art asia biz blog cat cloud club com coop dev edu email eus gal gov info int io jobs link live media mil mobi museum name net news online org page post pro shop site store tech tel travel web wiki work xxx xyz".split())
CALLING = frozenset("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 233 234 237 243 244 249 251 254 255 256 260 263 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 380 381 382 385 386 387 389 420 421 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998".split())
ISSUERS = (("4", (13, 16, 19)), ("5", (16,)), ("2", (16,)), ("34", (15,)), ("37", (15,)), ("6", (16, 17, 18, 19)), ("30", (14,)), ("36", (14,)), ("38", (14,)))
NETWORKS = ("0.", "10.", "127.", "169.254.", "192.0.2.", "192.168.", "198.51.100.", "203.0.113.", "255.")
KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xoxa-", "SG.", "eyJ", "ya29.", "npm_", "pypi-", "dop_v1_", "hf_", "shpat_", "AC", "key-")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "none", "null", "true", "false", "redacted", "default", "password", "123456")

#: Words before a span: for the kind, and against any.
CUES = {
    "email": r"mail|contact|write|reach|from|to", "ip": r"ip|host|server|address|addr|client|login", "card": r"card|visa|mastercard|amex|credit|debit|payment|account",
    "phone": r"phone|tel|call|fax|mobile|cell|contact|whatsapp", "credential": r"password|passwd|pwd|passphrase|token|secret|api[_ -]?key|access[_ -]?key|key|auth|bearer", "number": r"phone|tel|call|fax|mobile|cell|contact|number",
}
_CUES = {kind: re.compile(rf"\b(?:{words})\b[\"']?\s?[.:=]?\s*(?:is|at)?\s*[\"']?$", re.I) for kind, words in CUES.items()}
_AGAINST = re.compile(r"\b(?:version|ver|v|release|build|commit|sha|sha1|sha256|md5|checksum|hash|revision|uuid|isbn|issn|doi|page|pages|year|section|chapter|figure|table|id|no|rfc|issue|invoice|order)\b\s?[.:=#]?\s*$", re.I)
_FORMATS = re.compile(r"AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[pousr]_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}|[0-9a-f]{16,128}|[0-9A-F]{16,128}|sk[_-][A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,}")
_PHONE_SHAPE = re.compile(r"\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}[\x20-][0-9]{3,4}[\x20-]?[0-9]{3,5}|00[0-9]{1,3}[\x20-][0-9\x20-]{6,}")
BEFORE = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer does, but looking only around each '@'."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL_PART.match(text[start - 1]):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start; code points, end exclusive."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in _IP_ONCE.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def _entropy(token: str) -> float:
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def _vote(yes: bool, no: bool) -> int:
    return int(yes) - int(no and not yes)


def _votes(kind: str, token: str, before: str) -> tuple[int, ...]:
    """The five labelers' votes: 1 for, -1 against, 0 neither."""
    digits = re.sub(r"[^0-9]", "", token)
    context = _vote(bool(_CUES[kind].search(before)), bool(_AGAINST.search(before)))
    if kind == "email":
        local, _, domain = token.partition("@")
        top = domain.rsplit(".", 1)[-1].lower()
        return 1, _vote(top in DOMAINS or len(top) == 2 and top.isalpha(), True), context, _vote(local[0].isalnum() and len(local) <= 64, ".." in local), _vote(any(c.isalpha() for c in domain), True)
    if kind == "ip":
        parts = token.split(".")
        return 1, _vote(not token.startswith(NETWORKS), True), context, _vote(all(p == (p.lstrip("0") or "0") for p in parts), True), _vote(len(set(parts)) > 1 and max(map(len, parts)) > 1, True)
    if kind == "card":
        own = [lengths for first, lengths in ISSUERS if digits.startswith(first)]
        groups = re.split(r"[\x20-]", token)
        return 1, _vote(bool(own), True), context, _vote(any(len(digits) in n for n in own), True), _vote(len(groups) == 1 or all(len(g) >= 4 for g in groups[:-1]), True)
    if kind == "phone":
        known = any(digits[:n] in CALLING for n in (1, 2, 3))
        return 1, _vote(known, True), context, _vote(10 <= len(digits) <= 13, False), _vote(token.count("(") == token.count(")"), True)
    if kind == "number":
        area = len(digits) == 10 and "2" <= digits[0] and digits[1] < "9" or digits.startswith("00") and any(digits[2 : 2 + n] in CALLING for n in (1, 2, 3))
        groups = [g for g in re.split(r"[().\x20-]+", token) if g]
        return _vote(bool(_PHONE_SHAPE.fullmatch(token)), True), _vote(area, len(digits) != 10), context, _vote(9 <= len(digits) <= 11, len(digits) > 12), _vote(2 < len(groups) <= 5, len(groups) == 1)
    entropy, share = _entropy(token), len(digits) / len(token)
    kinds = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", token)))
    lower = token.lower()
    return (
        _vote(bool(_FORMATS.fullmatch(token)), token.isalpha() or bool(re.fullmatch(r"[A-Za-z]+[-_/]?[0-9]{1,4}", token))),
        _vote(token.startswith(KEY_PREFIXES), lower.startswith(PLACEHOLDERS)), context,
        _vote(entropy > 3.2 or entropy > 2.9 and share > 0.1, entropy < 2.5 or share == 0), _vote(len(kinds) >= 4 or len(token) >= 16 and not token.islower(), len(kinds) <= 2),
    )


def _place(c: str) -> str:
    return "e" if not c else "s" if c.isspace() else "q" if c in "\"'" else "k" if c in "=:" else "w" if c.isalnum() else "p"


def pattern(kind: str, text: str, a: int, b: int) -> str:
    """kind, votes, and the classifier's features of text[a:b]: buckets of sizes and shares, and what stands around it."""
    token, before = text[a:b], text[max(0, a - BEFORE) : a]
    votes = _votes(kind, token, before)
    digits, upper = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    turns = sum((x.isdigit(), x.isupper()) != (y.isdigit(), y.isupper()) for x, y in zip(token, token[1:]))
    cue = "c" if _CUES[kind].search(before) else "a" if _AGAINST.search(before) else "n"
    features = (min(len(token).bit_length(), 7), min(digits * 4 // len(token), 3), min(upper * 3 // len(token), 2), min(turns // 2, 4), min(int(_entropy(token)), 4), _place(text[a - 1 : a] if a else ""), _place(text[b : b + 1]), cue)
    return f"{kind}|{''.join('-0+'[v + 1] for v in votes)}|{','.join(map(str, features))}"


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of the base spans and of those that overlap no other: credentials, then numbers.

    A candidate is looked up among the taken spans by bisection, so the time follows the text's length.
    """
    out = [(*s, pattern(s[0], text, s[1], s[2])) for s in base]
    taken = _Taken([(a, b) for _, a, b in base])
    found = [m.span(1) for m in SECRET.finditer(text)]
    if DIGIT.search(text):
        found += [m.span() for m in TOKEN.finditer(text) if not m.group().isdigit()]
    for kind, spans in (("credential", sorted(set(found))), ("number", [m.span() for m in NUMBER.finditer(text)] if DIGIT.search(text) else [])):
        added = []
        for a, b in spans:
            if taken.free(a, b) and (not added or a >= added[-1][1]):
                added.append((a, b))
        out += [(kind, a, b, pattern(kind, text, a, b)) for a, b in added]
        taken = _Taken(taken.spans + added)
    return out


class _Taken:
    """Spans joined where they overlap, and whether another one is free of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))
        self.starts = [a for a, _ in self.spans]

    def free(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, b - 1) - 1
        return k < 0 or self.spans[k][1] <= a


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base, candidates): arrays of (kind, start, end) and (kind, start, end, pattern) of every whole text; the first candidates are the base spans."""
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    voted = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, candidates = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            base.append([dict(zip(("kind", "start", "stop"), s)) for s in found])
            candidates.append([dict(zip(("kind", "start", "stop", "pattern"), s)) for s in candidate_spans(text or "", found)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(candidates, voted)], ["id", "base", "candidates"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = "kind: string, start: bigint, stop: bigint"
    return map_slices(source, run, "text", f"id {dict(source.dtypes)['id']}, base array<struct<{fields}>>, candidates array<struct<{fields}, pattern: string>>")


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict[tuple[str, str], np.ndarray]]:
    """(posterior by votes "kind|votes", P(vote | class) by kind and labeler) by expectation maximisation over counts.

    The chances are a row for false and one for true candidates, each of a vote against, of none, and for. A small prior
    says that labelers are right more often than not, which settles which class is which.
    """
    by_votes: Counter = Counter()
    for p, n in counts.items():
        by_votes[p.rsplit("|", 1)[0]] += n
    posterior, tables = {}, {}
    for kind in BASE + ADDED:
        own = [(p, n, ["-0+".index(v) for v in p.split("|")[1]]) for p, n in sorted(by_votes.items()) if p.startswith(kind + "|")]
        if not own:
            continue
        n = np.array([c for _, c, _ in own], dtype=float)
        votes = np.array([v for _, _, v in own])
        z = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            share = np.clip((n * z).sum() / n.sum(), 0.01, 0.99)
            chance = np.empty((len(LABELERS), 2, 3))
            for j in range(len(LABELERS)):
                for c, weight in ((0, n * (1 - z)), (1, n * z)):
                    seen = np.bincount(votes[:, j], weights=weight, minlength=3) + np.array([1.0, 1.0, 1.0]) + (0, 0, c) + (1 - c, 0, 0)
                    chance[j, c] = seen / seen.sum()
            log = np.log([1 - share, share])[None, :] + sum(np.log(chance[j][:, votes[:, j]]).T for j in range(len(LABELERS)))
            z = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        posterior |= {p: float(v) for (p, _, _), v in zip(own, z)}
        tables |= {(kind, name): chance[j] for j, name in enumerate(LABELERS)}
    return posterior, tables


def reliability_table(spark: SparkSession, tables: dict[tuple[str, str], np.ndarray]) -> DataFrame:
    """(kind, labeler, true_for, true_against, false_for, false_against): how often a labeler votes so on true and false candidates."""
    rows = [(kind, name, float(t[1][2]), float(t[1][0]), float(t[0][2]), float(t[0][0])) for (kind, name), t in tables.items()]
    return spark.createDataFrame(rows, "kind string, labeler string, true_for double, true_against double, false_for double, false_against double")


def span_classifier(counts: dict[str, int], posterior: dict[str, float], rounds: int = 400) -> dict[str, float]:
    """Probability by pattern of a logistic model of each kind over its features alone, trained on the posteriors of all candidates."""
    out: dict[str, float] = {}
    for kind in BASE + ADDED:
        patterns = sorted(p for p in counts if p.startswith(kind + "|"))
        if not patterns:
            continue
        named: dict[str, int] = {"bias": 0}
        rows = [[0, *(named.setdefault(f"{j}:{v}", len(named)) for j, v in enumerate(p.rsplit("|", 1)[1].split(",")))] for p in patterns]
        x = np.zeros((len(rows), len(named)))
        for i, r in enumerate(rows):
            x[i, r] = 1
        y = np.array([posterior[p.rsplit("|", 1)[0]] for p in patterns])
        weight = np.array([counts[p] for p in patterns], dtype=float)
        weight /= weight.sum()
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            w -= 1.0 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
        out |= dict(zip(patterns, (1 / (1 + np.exp(-x @ w))).tolist()))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, base, added, n_candidates, n_doubtful): spans of every whole text, base ones by kind as listed and start, accepted ones likewise.

    n_candidates counts what was voted on beyond the base, n_doubtful base spans that the classifier would reject. Null and
    empty texts have none; repeated rows stay rows; very long texts are read whole, in time that follows their length;
    other columns aren't carried; an empty table gives no rows. The counts of patterns are of the whole corpus: patterns
    are combinations of a few buckets, so their number is bounded whatever the corpus, and only their counts reach the driver.
    """
    spans = materialize(extract(docs, id_col, text_col), "pii-spans")
    rows = spans.select(F.explode("candidates.pattern").alias("pattern")).groupBy("pattern").count().collect()
    counts = {r["pattern"]: r["count"] for r in rows}
    posterior, _ = reliabilities(counts)
    accepted = spans.sparkSession.sparkContext.broadcast(frozenset(p for p, v in span_classifier(counts, posterior).items() if v >= threshold))

    def decide(found: pa.Array) -> pa.Array:
        out = []
        for row in found.to_pylist():
            own = [(c["kind"] in BASE, c["pattern"] in accepted.value, c) for c in row or ()]
            kept = sorted(((c["kind"], c["start"], c["stop"]) for base, good, c in own if good and not base), key=lambda s: (ADDED.index(s[0]), s[1]))
            out.append({"added": [dict(zip(("kind", "start", "stop"), s)) for s in kept], "candidates": sum(not base for base, _, _ in own), "doubtful": sum(base and not good for base, good, _ in own)})
        return pa.array(out, kind)

    kind = pa.struct([("added", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))), ("candidates", pa.int64()), ("doubtful", pa.int64())])
    decided = F.arrow_udf(decide, "struct<added: array<struct<kind: string, start: bigint, stop: bigint>>, candidates: bigint, doubtful: bigint>")
    judged = spans.withColumn("judged", decided("candidates"))
    return judged.select("id", "base", F.col("judged.added").alias("added"), F.col("judged.candidates").alias("n_candidates"), F.col("judged.doubtful").alias("n_doubtful"))
