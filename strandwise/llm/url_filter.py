"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

A rule ``host/path`` fits its host and all subdomains where the URL's path starts with the rule's;
the longest rule decides. URLs that no rule fits are judged by a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.

Defined results: host is what follows the first ``://`` up to ``/ ? #`` or the end, with A-Z
lower-cased; path runs from there up to ``? #`` or the end; a null URL or one without ``://`` has
both empty and is judged by the model on no features, that is by its bias. Repeated rows get the
same answer; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, chunks, mix, parts

#: Fixed values, the parts of the labelled table: what unwanted and wanted hosts are named after. Hosts, words, domains and
#: paths of the tables that the operator is tested on are kept out of it.
BLOCKED_TOPICS = (
    "poker bingo slots roulette jackpot gambling lottery sportsbook blackjack baccarat "
    "viagra cialis meds steroids painkillers slimming xxx porn sex nude escort cams webcam-girls milf fetish hookup "
    "scam phishing malware keylogger botnet clickbait doorway popunder banner-exchange affiliate-click "
    "payday-loan fast-cash crypto-double get-rich ponzi forex-signals replica-watches fake-id counterfeit warez keygen torrent-crack cracked-apps"
).split()
ALLOWED_TOPICS = (
    "library university college school science physics chemistry biology history museum gallery archive "
    "news weather city council transport railway airport hospital clinic health nursing garden cooking recipes bakery "
    "football tennis rowing cycling hiking travel hotel island mountain river forest ocean astronomy geology "
    "music theatre cinema books poetry language dictionary translation grammar mathematics statistics software docs "
    "engineering architecture design photo crafts knitting pottery woodwork chess puzzles parenting kindergarten charity volunteers "
    "law parliament justice economy insurance accounting energy solar water climate wildlife birds horses dogs veterinary"
).split()
#: Words beside the topics: those that any name may hold, and those that mostly wanted or unwanted ones do.
COMPANIONS = "online world daily best top my the hub zone club center guide shop now house street one".split()
MANNERS = {1: "prize bonus vip hot instant easy 777 4u 24h deals xx mega lucky secret".split(), 0: "society institute project local national public group studio journal association courses north".split()}
ENDINGS = {1: "com net info biz top xyz click".split(), 0: "com net org edu info eu".split()}
PREFIXES = "", "www.", "web.", "home."
PLACES = {1: "/ /prizes /join/77 /promo/a1 /out/5521 /x/9 /index.html".split(), 0: "/ /about /index.html /news/2021/05/ /docs/intro /team /articles/5521".split()}


def _deal(text: str) -> int:
    return zlib.crc32(text.encode())


def labelled_names(each: int = 6, topics: dict[int, list[str]] | None = None) -> list[tuple[str, int]]:
    """Names of hosts with their label, 1 for block: each topic by itself and with ``each`` words beside it, before or after; half of these words are of the label's manner."""
    found = []
    for label, own in (topics or {1: BLOCKED_TOPICS, 0: ALLOWED_TOPICS}).items():
        for topic in own:
            start = _deal(topic)
            beside = [(MANNERS[label] if k % 2 else COMPANIONS)[(start + 5 * k) % len(MANNERS[label] if k % 2 else COMPANIONS)] for k in range(each)]
            found += [(topic, label), *((f"{word}-{topic}" if _deal(topic + word) % 2 else f"{topic}-{word}", label) for word in beside)]
    return found


def labelled_urls(names: Iterable[tuple[str, int]] | None = None, each: int = 1) -> list[tuple[str, int]]:
    """The small labelled URL table: ``each`` URLs for every name (all of ``labelled_names``, if none are given), dealt over endings, prefixes and paths by a checksum."""
    pick = lambda parts, n: parts[n % len(parts)]
    return [
        (f"https://{pick(PREFIXES, _deal(f'prefix {name} {k}'))}{name}.{pick(ENDINGS[label], _deal(f'ending {name} {k}'))}{pick(PLACES[label], _deal(f'path {name} {k}'))}", label)
        for name, label in (labelled_names() if names is None else names)
        for k in range(each)
    ]


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits; rules are (verdict, 'host/path').

    Among equally long rules the one listed first decides.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, pattern in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        same_length = [r for r in rules if len(r[1]) == len(pattern)]
        if len(same_length) > 1:
            ahead = same_length[: same_length.index((what, pattern))]
            for _, other in ahead:
                n, s, r = other.partition("/")
                fits = fits & ~(((host == n) | host.endswith("." + n)) & path.startswith(s + r))
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _grams(data: np.ndarray, offsets: np.ndarray, sizes: Sequence[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n, part by part: hashed n-grams by start position, and their bounds by document."""
    for n in sizes:
        last = np.maximum(offsets[1:] - n + 1, offsets[:-1])
        for a, b in parts(len(data)):
            own = data[a : b + n - 1]
            count = len(own) - n + 1
            if count <= 0:
                continue
            code = np.zeros(count, np.uint64)
            for k in range(n):
                code = (code << U64(8)) | own[k : k + count]
            slot = (mix(code + U64(n << 56)) >> U64(64 - bits)).astype(np.int64)
            yield slot, np.clip(np.stack([offsets[:-1], last]) - a, 0, count)


def _features(texts: list[str], sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the features that are not 0."""
    rows, slots, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for row, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        found = [slot for slot, _ in _grams(data, np.array([0, len(data)]), sizes, bits)]
        if found:
            slot, number = np.unique(np.concatenate(found), return_counts=True)
            rows.append(np.full(len(slot), row))
            slots.append(slot)
            values.append(number / number.sum() ** 0.5)
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def _split(url: str) -> tuple[str, str]:
    rest = url.partition("://")[2]
    ends = [i for i in (rest.find(c) for c in "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :].partition("#")[0].partition("?")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def model_text(host: str, path: str) -> str:
    return f"^{host}{path}$" if host or path else ""


class UrlModel:
    """Weights of the logistic regression; a few KB, whatever the data."""

    def __init__(self, weights: np.ndarray, bias: float, sizes: Sequence[int], bits: int) -> None:
        self.weights, self.bias, self.sizes, self.bits = weights, bias, tuple(sizes), bits

    @classmethod
    def train(cls, labelled: Iterable[tuple[str, int]], sizes: Sequence[int] = (3, 4, 5), bits: int = 14, steps: int = 300, l2: float = 1e-4, share: float = 0.25) -> UrlModel:
        """Minimise the mean log loss plus ``l2`` / 2 times the squared weights, by accelerated gradients.

        ``share`` is the weight of all URLs to block together: the share of such URLs that is
        expected, so that names without evidence either way are allowed.
        """
        pairs = sorted(set(labelled))
        row, slot, value = _features([model_text(*_split(u)) for u, _ in pairs], sizes, bits)
        used, slot = np.unique(slot, return_inverse=True)
        n, bias = len(pairs), len(used)  # the bias is one more feature, of value 1
        row, slot, value = np.append(row, np.arange(n)), np.append(slot, np.full(n, bias)), np.append(value, np.ones(n))
        y = np.array([label for _, label in pairs], np.float64)
        weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
        pace = 1 / (0.25 * float((weight[row] * value * value).sum()) + l2)
        w, ahead = np.zeros(bias + 1), np.zeros(bias + 1)
        for step in range(steps if n else 0):
            error = (1 / (1 + np.exp(-np.bincount(row, value * ahead[slot], minlength=n))) - y) * weight
            before, w = w, ahead - pace * (np.bincount(slot, value * error[row], minlength=bias + 1) + l2 * ahead)
            ahead = w + step / (step + 3) * (w - before)
        weights = np.zeros(1 << bits)
        weights[used] = w[:-1]
        return cls(weights, float(w[-1]), sizes, bits)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for slot, (begin, end) in _grams(data, offsets, self.sizes, self.bits):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[slot])])
            total += sums[end] - sums[begin]
            count += end - begin
        return 1 / (1 + np.exp(-(total / np.sqrt(np.maximum(count, 1)) + self.bias)))


def _score(batches: Iterable[pa.RecordBatch], model: UrlModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in chunks(batch, "model_text"):
            p = model.probabilities(data, offsets)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(p)], names=["page_id", "host", "path", "rule", "ruled", "p_block"])


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (of the model, for every URL)."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    parts = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, ruled = longest_rule(F.col("host"), F.col("path"), rules)
    some = (F.col("host") != "") | (F.col("path") != "")
    parts = parts.select("*", rule.alias("rule"), ruled.alias("ruled"), F.when(some, F.concat(F.lit("^"), F.col("host"), F.col("path"), F.lit("$"))).otherwise("").alias("model_text"))
    scored = parts.mapInArrow(lambda it: _score(it, model), "page_id long, host string, path string, rule string, ruled string, p_block double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
