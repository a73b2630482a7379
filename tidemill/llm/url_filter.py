"""URL filters: rules by host and path, and a logistic regression for urls that no rule fits.

The regression reads hashed character n-grams of host and path. It is trained on the driver
from a small labelled table (a parameter), by batch gradient steps over a few
hundred rows, with its intercept, which is deterministic; rows are weighted to ``BLOCKED_SHARE``; its weights are one fixed-size vector (``BUCKETS``
floats) that goes to the tasks with the function. Judging is one narrow pass over the url
column alone; nothing is shuffled.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged
by the method; of the rules that fit, the longest text wins, then the longest host; repeated
rows are returned as often as they come; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import lean, table

#: Fixed values: (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: The labelled table: urls that a corpus should take, then urls that it should not.
ALLOWED_URLS = (
    "https://www.city-library.example.org/en/catalogue/history",
    "http://museum.example.net/collections/ancient-maps.html",
    "https://blog.gardening.example.com/en/2021/roses",
    "https://news.harbour.example.org/fr/article/118",
    "http://physics.university.example.net/lectures/optics",
    "https://docs.compiler.example.com/en/reference/types",
    "https://recipes.example.org/de/brot/roggen.html",
    "http://weather.example.net/es/archivo/1998",
    "https://m.railway.example.com/en/timetable/445",
    "https://poems.example.org/en/spring",
    "http://www.botany.example.net/plants/ferns",
    "https://health.ministry.example.org/en/leaflets/12",
    "https://blog.there.example.com/en/369",
    "https://other.example.net/fr/414",
    "http://nation.example.org/es/797",
    "https://hearing.example.com/de/533/",
    "https://www.the-history.example.net/en/820.html",
    "https://blog.ration.example.com/fr/261",
    "http://thread.example.org/en/748",
    "https://m.outing.example.net/de/104",
    "https://school.example.com/en/lessons/algebra",
    "https://theatre.example.net/fr/programme",
    "http://forum.woodwork.example.org/thread/7782",
    "https://wiki.astronomy.example.com/en/nebula",
    "https://parliament.example.org/debates/2004/march",
    "http://www.folklore.example.net/en/tales/9",
    "https://cooking.example.org/es/sopas",
    "https://chess.example.com/en/openings/sicilian",
    "https://radio.example.net/de/sendung/77",
    "http://journal.medicine.example.org/en/volume/31",
    "https://birds.example.com/en/warblers",
    "https://bridge-engineering.example.net/en/arches",
)
BLOCKED_URLS = (
    "http://www.cheap-pills.example.com/en/450",
    "https://cheap-pills.example.net/buy-now",
    "http://pills-online.example.org/no-prescription",
    "https://cheapmeds.example.com/en/discount/pills",
    "https://spam-farm.example.org/en/728",
    "http://spam-farm.example.com/links/page/9",
    "http://link-farm.example.net/seo/backlinks",
    "https://linkspam.example.org/free/backlinks",
    "https://casino-bonus.example.com/en/free-spins",
    "http://best-casino.example.net/slots/jackpot",
    "https://online-casino.example.org/poker/bonus",
    "http://slots.example.com/casino/win-big",
    "https://xxx-videos.example.com/watch/331",
    "http://hot-xxx.example.net/cams/live",
    "https://adult-cams.example.org/en/live",
    "http://www.adult-xxx.example.net/gallery/4",
    "https://adult-x-videos.example.com/en/12",
    "https://porn-tube.example.com/videos/88",
    "http://free-porn.example.net/xxx",
    "https://payday-loans.example.com/en/instant-cash",
    "http://instant-loans.example.org/apply-now",
    "https://quick-cash.example.net/loans/bad-credit",
    "http://warez-download.example.com/cracked/keygen",
    "https://cracked-software.example.org/keygen/serial",
    "https://free-download.example.net/warez/torrent",
    "http://replica-watches.example.com/buy-cheap",
    "https://fake-rolex.example.org/cheap/replica",
    "http://win-prize.example.net/claim-now/free-gift",
    "https://click-here.example.com/free-iphone/claim",
    "https://ad-tracker.example.net/click/redirect",
    "http://malware-host.example.org/update.exe",
    "https://phish-login.example.com/secure/verify-account",
    "http://verify-bank.example.net/login/phish",
    "https://buy-followers.example.org/cheap/likes",
)

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
STEPS = 2000
STEP = 2.0
RIDGE = 5e-4
BLOCK_AT = 0.5
#: The share of urls to block among those that are judged; labelled rows are weighted to it, so that what is unknown is let through.
BLOCKED_SHARE = 0.2

_URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    found = _URL.match(url or "")
    if not found:
        return "", ""
    return found[1].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), found[2]


class Rules:
    """Looks a host's suffixes up, so the cost of a url doesn't grow with the number of rules."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, text, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for start, text, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or (len(text), len(suffix)) > best[0]):
                    best = ((len(text), len(suffix)), text, verdict)
        return best and best[1:]


def features(host: str, path: str, buckets: int = BUCKETS, sizes: Sequence[int] = SIZES) -> np.ndarray:
    """Buckets of the distinct n-grams of host and path, which have marks of their own at the ends."""
    found = set()
    for tag, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = part.encode("utf-8", "surrogatepass")
        for n in sizes:
            found.update(xxhash.xxh32_intdigest(raw[i : i + n], ord(tag)) % buckets for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


@lru_cache(maxsize=4)
def train(allowed: tuple[str, ...] = ALLOWED_URLS, blocked: tuple[str, ...] = BLOCKED_URLS) -> tuple[np.ndarray, float]:
    """(weights, bias) of the probability to block; rows are scaled to unit length."""
    urls = [*allowed, *blocked]
    x = np.zeros((len(urls), BUCKETS), np.float64)
    for i, url in enumerate(urls):
        at = features(*split_url(url))
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    y = np.r_[np.zeros(len(allowed)), np.ones(len(blocked))]
    share = np.where(y == 1, BLOCKED_SHARE / max(1, len(blocked)), (1 - BLOCKED_SHARE) / max(1, len(allowed)))
    used = np.flatnonzero(x.any(axis=0))
    x, w, b = x[:, used], np.zeros(len(used)), 0.0
    for _ in range(STEPS):
        off = share * (1 / (1 + np.exp(-(x @ w + b))) - y)
        w -= STEP * (x.T @ off + RIDGE * w)
        b -= STEP * off.sum()
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, float(b)


def block_probability(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    at = features(host, path)
    return float(1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(max(1, len(at))) + bias))))


def _judge(rules: tuple[tuple[str, str], ...], weights: np.ndarray, bias: float):
    def run(batches):
        book = Rules(rules)
        for batch in batches:
            hosts, paths, texts, verdicts, scores = [], [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                p = block_probability(host, path, weights, bias)
                text, verdict = book.find(host, path) or (None, "block" if p >= BLOCK_AT else "allow")
                hosts.append(host)
                paths.append(path)
                texts.append(text)
                verdicts.append(verdict)
                scores.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, texts, verdicts)), pa.array(scores, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, allowed: Sequence[str] = ALLOWED_URLS, blocked: Sequence[str] = BLOCKED_URLS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)``; ``score`` is the method's probability to block, rule or not."""
    weights, bias = train(tuple(allowed), tuple(blocked))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return narrow.mapInArrow(lean(_judge(tuple(rules), weights, bias)), "page_id long, host string, path string, rule string, verdict string, score double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
