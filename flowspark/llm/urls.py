"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick.

A rule names a host (with all its subdomains) and the start of a path; of the rules that fit a URL
the longest decides. URLs without a rule are judged by terms anywhere in the URL, query string and
fragment included. A term counts where both its ends are word boundaries (no ASCII letter or digit follows on). One strict term rejects; soft
terms reject together, when the weights of the distinct ones found reach a limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The vocabulary: terms that reject alone, and terms that reject together with their weights.
STRICT = ("casino", "casinos", "porn", "xxx", "viagra", "gambling", "escort", "sportsbook")
SOFT = {"bets": 1.0, "bet": 1.0, "free": 1.0, "win": 1.0, "pills": 1.0, "cheap": 1.0, "ads": 1.0, "track": 1.0, "poker": 1.0,
        "slots": 1.0, "bonus": 1.0, "loans": 1.0, "adult": 1.0, "nude": 1.0, "jackpot": 1.0, "pharmacy": 1.0, "dating": 1.0,
        "popup": 0.5, "promo": 0.5, "click": 0.5, "deal": 0.5, "deals": 0.5}
SOFT_LIMIT = 2.0
#: Characters that go on a word.
WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules and terms are policy, not data: tables beyond this size are refused.
MOST_ENTRIES = 1_000_000


@dataclass
class Policy:
    rules: list[tuple[str, str, str]] = field(default_factory=list)      # (host, path, verdict)
    strict: tuple[str, ...] = STRICT
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = SOFT_LIMIT

    def __post_init__(self):
        if len(self.rules) + len(self.strict) + len(self.soft) > MOST_ENTRIES:
            raise ValueError("rules and terms are too many to be sent to every task")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in self.rules:
            self.by_host.setdefault(host, []).append((path, verdict))


class Matcher:
    """The policy as a task holds it."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.terms = ahocorasick.Automaton()
        for term, weight in policy.soft.items():
            self.terms.add_word(term, (term, weight))
        for term in policy.strict:
            self.terms.add_word(term, (term, None))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones the first by text."""
        best = None
        at = 0
        while True:
            suffix = host[at:]
            for start, verdict in self.policy.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or (-len(suffix + start), suffix + start) < (-len(best[0]), best[0])):
                    best = (suffix + start, verdict)
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1

    def hits(self, text: str) -> tuple[int, int, float]:
        """Distinct strict and soft terms found in a lower-cased URL, and the sum of the soft ones' weights."""
        strict, soft = set(), {}
        if len(self.terms):
            for end, (term, weight) in self.terms.iter(text):
                before, after = end - len(term), end + 1
                if before >= 0 and text[before] in WORD or after < len(text) and text[after] in WORD:
                    continue
                if weight is None:
                    strict.add(term)
                else:
                    soft[term] = weight
        return len(strict), len(soft), sum(soft.values())


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.length(rest) < F.length(url), F.substring(url, F.length(rest) + 4, F.length(url)))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    after = F.when(F.length(rest) < F.length(url), F.substring(url, F.length(rest) + 4, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, policy: Policy) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict, strict_hits, soft_hits,
    soft_weight), one row for each row of pages; only page_id and url are read. A null URL, or one
    without "://", has an empty host and path and fits no rule; a null one holds no term: it is allowed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(policy)
        for batch in batches:
            rules, verdicts, strict, soft, weights = [], [], [], [], []
            for host, path, url in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                found, (hard, some, weight) = match.rule(host, path), match.hits(url)
                rules.append(found[0] if found else None)
                verdicts.append(found[1] if found else "block" if hard or weight >= policy.soft_limit and some > 1 else "allow")
                strict.append(hard)
                soft.append(some)
                weights.append(weight)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(strict, pa.int32()),
                 pa.array(soft, pa.int32()), pa.array(weights, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"])
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        F.coalesce(F.translate("url", UPPER, LOWER), F.lit("")).alias("place")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double")
