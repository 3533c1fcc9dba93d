"""URL filters: pattern rules indexed by their rarest literal token.

A rule (host, path, verdict) fits its host and all subdomains if the URL's path starts
with the rule's.  Its literal tokens are the labels of its host and the complete segments
of its path.  The tokens' frequencies are counted over all URLs; each rule is filed under
its rarest one.  A URL's tokens fetch the candidate rules, and only those run their
regular expression; the longest rule that fits wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host without port or user, a path that starts with ``/``, and ``allow`` or ``block``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Labels as ``.label``, complete path segments as ``/segment``."""
        return [f".{x}" for x in self.host.split(".")] + [f"/{x}" for x in self.path.split("/")[:-1] if x]

    @property
    def pattern(self) -> re.Pattern:
        """Fits host and path joined by a line feed after the host."""
        return re.compile(rf"(?:.*\.)?{re.escape(self.host)}\n{re.escape(self.path)}", re.S)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    def marked(text: Column, sep: str, mark: str) -> Column:
        parts = F.filter(F.split(text, re.escape(sep), -1), lambda x: x != "")
        return F.transform(parts, lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(F.concat(marked(host, ".", "."), marked(path, "/", "/")))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """The rule index.  ``urls`` has host and path; only tokens that occur in rules are counted."""
    vocabulary = sorted({t for r in rules for t in r.tokens})
    if not vocabulary:
        return {}
    words = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in vocabulary], "token string"))
    seen = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    counts = {r["token"]: r["n"] for r in
              seen.join(words, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
    return index


def judge(pages: DataFrame, rules: list[Rule], otherwise: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict (columns of these names are replaced).

    ``pages`` needs url.  Null, or a url without ``://``, has empty host and path, fits no
    rule and gets ``otherwise``, as do all urls without a fitting rule (rule is null then).
    Of rules of the same length the first by name wins, and block before allow.
    """
    own = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in own]
    parsed = pages.select(*keep, host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    index = {t: sorted(((-len(r.name), r.name, r.verdict != "block", r.verdict, r.pattern) for r in found),
                       key=lambda x: x[:3])
             for t, found in rarest_tokens(parsed, rules).items()}
    shared = pages.sparkSession.sparkContext.broadcast(index)

    def fit(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        filed = shared.value
        names, verdicts = [], []
        for host, path in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            tokens = {f".{x}" for x in host.split(".")} | {f"/{x}" for x in path.split("/")}
            whole, best = f"{host}\n{path}", None
            for token in tokens & filed.keys():
                for rule in filed[token]:
                    if (best is None or rule[:3] < best[:3]) and rule[4].match(whole):
                        best = rule
            names.append(best and best[1])
            verdicts.append(best[3] if best else otherwise)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                                          ["rule", "verdict"])

    found = parsed.withColumn("_fit", F.arrow_udf(fit, "rule string, verdict string")("host", "path"))
    return found.select(*keep, "host", "path", "_fit.rule", "_fit.verdict")
