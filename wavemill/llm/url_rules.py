"""URL filters: pattern rules indexed by their rarest literal token.

Each rule names the tokens that every URL it matches must hold. Token frequencies are
counted over all URLs, and a rule is filed under its rarest token. A URL's own tokens
fetch the rules filed under them; only these run their regular expression. Place rules
(host and path prefix) go through the same index; the longest that fits decides. Where
none fits, a URL is blocked if a blocking pattern matches, else allowed.

Defined results: without ``://`` (or null) host and path are empty, no place rule fits,
and patterns see the text as it is (null: empty). Rows are independent, so repeated rows
agree. A rule without literal tokens is tried on every URL. Equally long place rules:
the one that blocks wins, then the smaller name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: The index is held by every task; more rules than this are refused.
MOST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    pattern: str
    literals: tuple[str, ...]
    place: bool = False


def place_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host and its subdomains, paths that start with the rule's."""
    host, _, path = name.partition("/")
    # The last stretch of the path may go on in the URL, so it is no whole token unless something ends it.
    settled = re.match(r"(.*[^A-Za-z0-9])?", path, re.S).group()
    literals = tuple(re.findall(TOKEN, f"{host} {settled}".lower()))
    return Rule(name, verdict, rf"(?:[^/]*\.)?{re.escape(host)}/{re.escape(path)}", literals, True)


def query_key(key: str) -> Rule:
    return Rule(f"?{key}=", "block", rf"[?&]{key}=", (key,))


def page_word(word: str) -> Rule:
    return Rule(f"/{word}", "block", rf"/{word}(?:[/?#.]|$)", (word,))


def file_ending(ending: str) -> Rule:
    return Rule(f".{ending}", "block", rf"\.{ending}(?:[?#]|$)", (ending,))


#: The method's own rules: session links, account pages, files that are no text, trackers.
PATTERNS = (
    *map(query_key, ("sid", "phpsessid", "sessionid", "jsessionid")),
    *map(page_word, ("login", "logout", "signup", "cart", "checkout")),
    *map(file_ending, ("jpg", "png", "gif", "zip", "exe", "mp4", "css")),
    Rule("ads-track", "block", r"^[^:]*://(?:[^/?#]*\.)?ads-track\.", ("ads", "track")),
)


def address(url: str) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a URL."""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.encode("utf-8", "replace").lower().decode(), path


def _ascii_lower(url: str) -> str:
    return url.encode("utf-8", "replace").lower().decode()


def token_frequencies(pages: DataFrame, url: str, tokens: Sequence[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens occurs. What comes back has a row per rule token at most."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url)), F.lit(f"({TOKEN})")))
    of_rules = F.array(*[F.lit(t) for t in sorted(set(tokens))]) if tokens else F.array().cast("array<string>")
    counted = pages.select(F.explode(F.array_intersect(held, of_rules)).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in counted.collect()}


def index_rules(rules: Sequence[Rule], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by their rarest literal token; under the empty token those without any."""
    index = defaultdict(list)
    for at, rule in enumerate(rules):
        index[min(rule.literals, key=lambda t: (frequency.get(t, 0), t), default="")].append(at)
    return dict(index)


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", carry: Sequence[str] = ("page_id",)
) -> DataFrame:
    """Carried columns, ``host``, ``path``, ``rule``, ``verdict``, ``pattern`` and ``n_tried`` (rules run)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} fit the index held by each task")
    frequency = token_frequencies(pages, url, [t for r in rules for t in r.literals])
    index = index_rules(rules, frequency)
    kept = pages.select(*carry, F.col(url).cast("string").alias("__url"))
    added = {n: "string" for n in ("host", "path", "rule", "verdict", "pattern")} | {"n_tried": "int"}
    schema = ", ".join([*(f"`{n}` {t}" for n, t in kept.dtypes[:-1]), *(f"{n} {t}" for n, t in added.items())])
    tokens_of = re.compile(TOKEN).findall

    def judge(url: str | None, compiled) -> tuple:
        host, path = address(url or "")
        lowered = _ascii_lower(url or "")
        tried = [i for t in {"", *tokens_of(lowered)} for i in index.get(t, ())]
        fits = [rules[i] for i in tried if compiled[i](host + path if rules[i].place else lowered)]
        places = [r for r in fits if r.place]
        first = min(places, key=lambda r: (-len(r.name), r.verdict != "block", r.name), default=None)
        pattern = min((r.name for r in fits if not r.place and r.verdict == "block"), default=None)
        verdict = first.verdict if first else "block" if pattern else "allow"
        return host, path, first and first.name, verdict, pattern, len(tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.S).match if r.place else re.compile(r.pattern, re.S).search for r in rules]
        for batch in batches:
            judged = [judge(u, compiled) for u in batch.column(len(carry)).to_pylist()]
            columns = [
                pa.array([j[n] for j in judged], pa.int32() if kind == "int" else pa.string())
                for n, kind in enumerate(added.values())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*carry, *added])

    return kept.mapInArrow(run, schema)
