"""URL filter: listed rules first, then a logistic regression on hashed character n-grams of host and path.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed; repeated rows and ids are kept; urls of any length are read whole; an empty table gives an
empty result; other columns are not touched. Of two rules that fit, the longer (host and path) wins,
then the one that sorts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import kernels as K
from millrace.llm import linear

BITS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The words of the small labelled table: what unwanted hosts and paths are often named after, and wanted ones.
BLOCKED_HOSTS = "casino poker betting slots jackpot lottery viagra pharmacy pills steroids payday loans replica escorts porn adult camgirls torrent warez keygen phishing malware giveaway prizes clicks adserver popunder tracking affiliate spammer".split()
BLOCKED_PATHS = "/win/now /bonus/claim.php /free-download/setup.exe /go/offer /click/redirect /banner/ads.js /verify/account/login.php /cheap/discount-pills /xxx/videos /aff/track.gif".split()
ALLOWED_HOSTS = "library museum university school weather history garden recipes travel science journal council hospital theatre football cycling railway archive gallery institute planning orchestra bakery mapping parliament geography chess farming village harbour".split()
ALLOWED_PATHS = "/about /articles/2021/title-of-text.html /contact/ /research/paper.pdf /opening-hours /docs/guide/index.html /events/spring/ /people/team.html /collection/item /wiki/Main_Page".split()
SYLLABLES = "an ate con de ed en ent er es for ful ing ion land ment ness on or per re th tion ton ver".split()  # frequent in English: invented names of them are ordinary hosts
PLAIN_PATHS = ("/", "/index.html", "/en/1", "/p/27", "/2022/3.html", "")  # say nothing: in both parts of the table
_SHAPES = ("{0}.{z}", "www.{0}{1}.{z}", "blog.{0}.{z}", "m.{0}{1}.{z}", "{0}-{1}.{z}", "my{0}.{z}")
_ZONES = ("com", "net", "org", "example.com", "example.org", "info")


def labelled() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The table, as (host, path) to block and to allow: each word in each shape, with neighbours in its list, zones in turn, and a path of its list or one that says nothing."""
    out = []
    for hosts, paths in ((BLOCKED_HOSTS, BLOCKED_PATHS), (ALLOWED_HOSTS, ALLOWED_PATHS)):
        out.append([(shape.format(w, hosts[(i + 1 + k) % len(hosts)], z=_ZONES[(i + k) % len(_ZONES)]), paths[(i + 3 * k) % len(paths)] if k % 2 else PLAIN_PATHS[(i + k) % len(PLAIN_PATHS)]) for i, w in enumerate(hosts) for k, shape in enumerate(_SHAPES)])
    names = [a + b + SYLLABLES[(5 * i + 7 * k) % len(SYLLABLES)] for i, a in enumerate(SYLLABLES) for k, b in enumerate(SYLLABLES) if (i + k) % 3 == 0]
    out[1] += [(_SHAPES[2 * (k % 2)].format(w, z=_ZONES[k // 2 % len(_ZONES)]), PLAIN_PATHS[k % len(PLAIN_PATHS)]) for k, w in enumerate(names)]
    return out[0], out[1]


def parts(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def grams(host: pa.Array, path: pa.Array):
    """For slices of rows: first row, end row, distinct numbers of the 3- to 5-grams of characters of host (marked ends) and path, offsets."""
    found = []
    rows = len(host)
    for salt, column, mark in ((1, host, "."), (2, path, "/")):
        mark = pa.scalar(mark, pa.large_string())
        texts = pc.binary_join_element_wise(mark, column.fill_null("").cast(pa.large_string()), mark, pa.scalar("", pa.large_string()))
        data, offsets = K.text_buffers(texts)
        _, at, lead = K.code_points(data, offsets)
        row = np.repeat(np.arange(rows), np.diff(at))
        for k in (3, 4, 5):
            n = max(0, len(row) - k + 1)
            first = np.flatnonzero(row[:n] == row[k - 1 :]) if n else np.zeros(0, np.int64)
            found.append((K.span_hashes(data, lead[first], lead[first + k], salt) >> np.uint64(64 - BITS), row[first]))
    h, r = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    index, cut = K.distinct_in_rows(h, r, rows)
    return linear.Sparse(index.astype(np.int64), cut)


def fit(blocked: list[tuple[str, str]] | None = None, allowed: list[tuple[str, str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The model from (host, path) pairs to block and to allow; by default those of labelled()."""
    if blocked is None or allowed is None:
        blocked, allowed = labelled()
    both = [*blocked, *allowed]
    x = grams(pa.array([h for h, _ in both], pa.string()), pa.array([p for _, p in both], pa.string()))
    y = np.arange(len(both)) < len(blocked)
    return linear.fit(x, np.zeros((len(both), 0)), y, 1 << BITS, features=1 << BITS, l2=1e-4)


def probability(model: tuple[np.ndarray, np.ndarray], host: pa.Array, path: pa.Array) -> np.ndarray:
    return linear.sigmoid(grams(host, path).dot(model[0]) + model[1][-1])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], model: tuple[np.ndarray, np.ndarray], id: str = "page_id", url: str = "url", least: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability to be blocked, which blocks if it is `least` or more). rules: (block or allow, host, path)."""
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("u"))
    host, path = parts(F.col("u"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path")).fillna("", ["host", "path"])
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"))
    held = pages.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = probability(held.value, batch.column(1), batch.column(2))
            host, listed = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            verdict = [one or ("block" if q >= least and h else "allow") for one, q, h in zip(listed, p.tolist(), host, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdict), pa.array(p)], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(apply, f"page_id {rows.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string, score double")
