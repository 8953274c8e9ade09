"""Main content of web pages, without menus, notices, bylines, teasers, comments and footers.

Pages are read as a stream of standard-library parser events, one line per text node. The logarithm
of each line's text-to-tag ratio is smoothed with a Gaussian over its neighbours, and two clusters
of the smoothed values split the lines of a page at a threshold. The container with most running
text in the high cluster wins its page.

A short article can have less text than the comments or teasers beside it, so pages of a site vote:
a container's support is how often containers of its kind (tag, id and class) win where they occur,
on the site, backed by all sites and by the page itself. The content region of a page is the best
supported container that reaches the threshold (the lower of the page's and its site's); blocks
that are mostly links are never part of it, nested containers only with a fair part of its text.

Captures without HTML have no tags. Their lines are labelled by what the captures with HTML say of
the same line, its outline, and what follows it (label and succession counts over all captures),
in the most likely sequence.

Defined results: a capture without text has no lines; error pages, empty pages and pages without
running text have none; of several deliveries of a page the latest counts; malformed markup is
read as far as the parser gets; whitespace inside a line is not compared; a page without a site
is judged by all sites and itself.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenar.session import cut_lineage

SIGMA = 1.0  # of the Gaussian, in lines
RADIUS = 3
MIN_TEXT = 60  # characters of the longest line of a container that may be a region, or nested in one
NESTED_SHARE = 0.5  # of the region's text a nested container needs to count
LINK_SHARE = 0.5  # of a block's text from which it counts as a link list
REACH = 0.8  # of the threshold that the region's highest line needs
PRIOR = 2.0  # pages for which all sites count against a site's own votes, and the page itself against all sites
MIN_SUPPORT = 0.3  # of the region
MIN_SEEN = 10  # lines from which a key's counts are believed before a coarser key's
SALTS = 8  # tasks over which the pages of one site are spread when they meet its votes

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CONTAINERS = frozenset("html body div section article main aside nav footer header td th form dialog".split())
_BLOCKS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption caption tr".split())
_LINKS = frozenset(("a", "button"))
_SILENT = frozenset(("script", "style", "template", "noscript", "title"))

_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


class LineEvents(HTMLParser):
    """Lines of a page: text, tags since the last line, container, block, and whether inside a link."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.above: list[int] = [-1]  # parent of each container
        self.kinds: list[str] = [""]  # tag, id and class of each container; without these, below which one it is
        self._open: list[tuple[str, int, int]] = []  # tag, container and block outside of it
        self._container = self._block = self._tags = self._blocks = 0
        self._link = self._silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if tag in _VOID:
            return
        self._open.append((tag, self._container, self._block))
        if tag in _CONTAINERS:
            named = "|".join([v for k, v in attrs if v and (k == "id" or k == "class")])
            self.kinds.append(f"{tag}|{named}" if named else f"{self.kinds[self._container]}>{tag}")
            self.above.append(self._container)
            self._container = len(self.above) - 1
            self._blocks += 1
            self._block = self._blocks
        elif tag in _BLOCKS:
            self._blocks += 1
            self._block = self._blocks
        elif tag in _LINKS:
            self._link += 1
        elif tag in _SILENT:
            self._silent += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._tags += 1

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        open_ = self._open
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == tag:
                break
        else:
            return
        while len(open_) > k:
            name, self._container, self._block = open_.pop()
            if name in _LINKS:
                self._link -= 1
            elif name in _SILENT:
                self._silent -= 1

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self._silent:
            self.lines.append((text, self._tags, self._container, self._block, self._link > 0))
            self._tags = 0


def page_lines(html: str) -> LineEvents:
    events = LineEvents()
    try:
        events.feed(html)
        events.close()
    except (AssertionError, ValueError):  # what was read so far counts
        pass
    return events


@dataclass
class Candidate:
    """A container that may be the content region of its page, and the lines that would be content then."""

    kind: int  # hash of tag, id and class
    won: bool
    mass: float  # characters of running text in the high cluster
    peak: float  # highest smoothed value of a running line
    lines: list[int]


def page_regions(events: LineEvents) -> tuple[float, list[int], list[Candidate]]:
    """Threshold between the page's clusters, hashed kinds of its containers with running text, and candidates."""
    lines = events.lines
    if not lines:
        return 0.0, [], []
    size = np.array([len(x[0]) for x in lines], np.float64)
    ratio = np.log1p(size / np.array([max(1, x[1]) for x in lines]))
    padded = np.concatenate([np.zeros(RADIUS), ratio, np.zeros(RADIUS)])
    smooth = np.convolve(padded, _KERNEL, "valid")
    threshold = _two_means(smooth)
    link_text: dict[int, float] = {}
    block_text: dict[int, float] = {}
    chars_of = size.tolist()
    for (_, _, _, block, link), chars in zip(lines, chars_of):
        block_text[block] = block_text.get(block, 0.0) + chars
        if link:
            link_text[block] = link_text.get(block, 0.0) + chars
    linked = {b for b, chars in link_text.items() if chars >= LINK_SHARE * block_text[b]}
    mass: dict[int, float] = {}
    longest: dict[int, float] = {}
    peak: dict[int, float] = {}
    own: dict[int, list[int]] = {}
    for k, (x, chars, value) in enumerate(zip(lines, chars_of, smooth.tolist())):
        if x[3] not in linked:
            c = x[2]
            own.setdefault(c, []).append(k)
            peak[c] = max(peak.get(c, 0.0), value)
            longest[c] = max(longest.get(c, 0.0), chars)
            mass[c] = mass.get(c, 0.0) + (chars if value > threshold else 0.0)
    able = [c for c in own if longest[c] >= MIN_TEXT]
    best = max((c for c in able if mass[c] > 0), key=lambda c: (mass[c], -c), default=None)
    out = []
    for region in able:
        least = NESTED_SHARE * max(mass[region], 1.0)
        inside = {region}
        for c in range(region + 1, len(events.above)):
            if events.above[c] in inside and mass.get(c, 0.0) >= least and longest[c] >= MIN_TEXT:
                inside.add(c)
        numbers = sorted(k for c in inside for k in own[c]) if len(inside) > 1 else own[region]
        out.append(Candidate(_digest(events.kinds[region]), region == best, mass[region], peak[region], numbers))
    return threshold, list({_digest(events.kinds[c]) for c in own}) if best is not None else [], out


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _two_means(values: np.ndarray) -> float:
    """Boundary between the two clusters of one-dimensional 2-means, started at the extremes."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        upper = values > cut
        if not upper.any() or upper.all():
            break
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


# ---------------------------------------------------------------- captures without HTML


def line_keys(line: str, site: str | None) -> tuple[int, int, int]:
    """Hashes of a line, of its outline with the first word, and of its outline alone; digits and the site's name are masked."""
    masked = " ".join(line.split())
    if site:
        masked = masked.replace(site, "\x01")
    masked = "".join(["0" if c.isdigit() else c for c in masked])
    words = masked.split(" ")
    count = len(words) if len(words) <= 4 else 8 if len(words) <= 8 else 16 if len(words) <= 16 else 32 if len(words) <= 32 else 64
    outline = f"{count}|{masked[-1:] if not masked[-1:].isalnum() else 'x'}|{all(w[:1].isupper() for w in words)}|{masked[:1].isalnum()}"
    first = f"{outline}|{words[0]}" if count <= 8 else outline
    return _digest(f"L{masked}"), _digest(f"F{first}"), _digest(f"O{outline}")


def page_keys(lines: list[str], site: str | None) -> list[list[int]]:
    """Keys of each line of a page, the most telling first: the line, its outline between its neighbours', with its first word, alone."""
    single = [line_keys(x, site) for x in lines]
    beside = [0, *[k[1] for k in single], 0]
    around = [_digest(f"{beside[i]} {k[2]} {beside[i + 2]}") for i, k in enumerate(single)]
    return [[k[0], a, k[1], k[2]] for k, a in zip(single, around)]


_REGION = pa.struct([("kind", pa.int64()), ("won", pa.bool_()), ("mass", pa.float64()), ("peak", pa.float64()), ("lines", pa.list_(pa.int32()))])
_PARSED = (
    "page_id bigint, ingested_at timestamp, uid bigint, site string, has_text boolean, threshold double, kinds array<bigint>, "
    "regions array<struct<kind:bigint,won:boolean,mass:double,peak:double,lines:array<int>>>, keys array<array<bigint>>"
)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions with lines as in the text, where there is one; keys only where parsed lines and text lines are the same."""
    for batch in batches:
        thresholds, kinds, regions, keys = [], [], [], []
        for site, html, text in zip(*(batch.column(n).to_pylist() for n in ("site", "raw_html", "plain_text"))):
            events = page_lines(html)
            threshold, seen, found = page_regions(events)
            given = None if text is None else text.split("\n")
            if given is not None and len(given) != len(events.lines):
                place = aligned([x[0] for x in events.lines], given)
                for c in found:
                    c.lines = [place[k] for k in c.lines if k in place]
                keys.append(None)
            else:
                keys.append(page_keys([x[0] for x in events.lines], site))
            thresholds.append(threshold)
            kinds.append(seen)
            regions.append([vars(c) for c in found])
        made = [pa.array(thresholds, pa.float64()), pa.array(kinds, pa.list_(pa.int64())), pa.array(regions, pa.list_(_REGION)), pa.array(keys, pa.list_(pa.list_(pa.int64())))]
        kept = [batch.column(n) for n in ("page_id", "ingested_at", "uid", "site")]
        yield pa.RecordBatch.from_arrays([*kept, pa.compute.is_valid(batch.column("plain_text")), *made], names=["page_id", "ingested_at", "uid", "site", "has_text", "threshold", "kinds", "regions", "keys"])


def aligned(parsed: list[str], given: list[str]) -> dict[int, int]:
    """Places in ``given`` of the lines of ``parsed`` in a longest common subsequence, whitespace aside."""
    a, b = [" ".join(x.split()) for x in parsed], [" ".join(x.split()) for x in given]
    out: dict[int, int] = {}
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        out[low] = low
        low += 1
    tail = 0
    while tail < high - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
        out[len(a) - tail] = len(b) - tail
    where: dict[str, list[int]] = {}
    for j in range(low, len(b) - tail):
        where.setdefault(b[j], []).append(j)
    # ends[n]: the least place in ``given`` at which a common subsequence of n + 1 lines can end
    ends: list[int] = []
    chains: list[tuple[int, int, tuple | None]] = []
    for i in range(low, len(a) - tail):
        for j in reversed(where.get(a[i], ()) if a[i] else ()):
            n = bisect_left(ends, j)
            chain = (i, j, chains[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[n], chains[n] = j, chain
    last = chains[-1] if chains else None
    while last is not None:
        out[last[0]] = last[1]
        last = last[2]
    return out


def _with_votes(parsed: DataFrame) -> DataFrame:
    """``uid, page_id, ingested_at, has_text, lines``: of each capture the lines of its best supported region."""
    pages = parsed.withColumn("site", F.coalesce("site", F.concat(F.lit("\0"), F.col("uid"))))
    won = F.exists("regions", lambda r: r.won)
    winner = F.element_at(F.filter("regions", lambda r: r.won), 1).getField("kind")
    shown = pages.filter(won).select("site", winner.alias("winner"), F.explode("kinds").alias("kind"))
    by_site = shown.groupBy("site", "kind").agg(F.sum((F.col("winner") == F.col("kind")).cast("double")).alias("v"), F.count("*").cast("double").alias("n"))
    by_kind = by_site.groupBy("kind").agg(F.sum("v").alias("all_v"), F.sum("n").alias("all_n"))
    cuts = pages.filter("size(regions) > 0").groupBy("site").agg(F.sum("threshold").alias("cut_sum"), F.count("*").cast("double").alias("cut_n"))
    votes = by_site.join(by_kind, "kind").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    site_cuts = cuts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod("uid", F.lit(SALTS)).cast("int")).select("uid", "page_id", "ingested_at", "has_text", "site", "salt", "threshold", F.explode_outer("regions").alias("r"))
    rows = salted.select("*", F.col("r.kind").alias("kind")).join(site_cuts, ["site", "salt"], "left").join(votes, ["site", "kind", "salt"], "left").na.fill(0.0, ["v", "n", "all_v", "all_n", "cut_sum", "cut_n"])
    own = F.coalesce(F.col("r.won"), F.lit(False)).cast("double")
    behind = (F.col("all_v") + PRIOR * own) / (F.col("all_n") + PRIOR)
    support = (F.col("v") + PRIOR * behind) / (F.col("n") + PRIOR)
    cut = F.least("threshold", (F.col("cut_sum") + PRIOR * F.col("threshold")) / (F.col("cut_n") + PRIOR))
    fits = F.coalesce((F.col("r.peak") > REACH * cut) & (support >= MIN_SUPPORT), F.lit(False))
    lines = F.when(fits, F.col("r.lines")).otherwise(F.array().cast("array<int>"))
    choice = F.max(F.struct(fits.alias("fits"), support.alias("support"), F.col("r.mass").alias("mass"), F.negative(F.coalesce(F.element_at("r.lines", 1), F.lit(0))).alias("early"), lines.alias("lines"))).alias("best")
    return rows.groupBy("uid", "page_id", "ingested_at", "has_text").agg(choice).select("uid", "page_id", "ingested_at", "has_text", F.col("best.lines").alias("lines"))


def _explode_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [page_keys(text.split("\n"), site) for site, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.list_(pa.int64())))], names=["page_id", "ingested_at", "keys"])


def _likeliest(stats: list[dict | None]) -> list[bool]:
    """Most likely labels of a line sequence, given what is known of each line's key.

    ``n{y}{z}`` counts its lines labelled y before one labelled z, ``b{y}{z}`` those labelled z after
    one labelled y. Lines without counts say nothing.
    """
    totals = [sum(s[f"n{y}0"] + s[f"n{y}1"] for s in stats if s) for y in (0, 1)]
    prior = min(max((totals[1] + 1.0) / (sum(totals) + 2.0), 0.05), 0.95)
    log_prior = [math.log(1 - prior), math.log(prior)]
    best: list[float] = []
    back: list[list[int]] = []
    before: list[list[float]] | None = None
    for k, s in enumerate(stats):
        after = [[s[f"n{y}{z}"] + 0.2 for z in (0, 1)] for y in (0, 1)] if s else [[1.0, 1.0], [1.0, 1.0]]
        ahead = [[s[f"b{y}{z}"] + 0.2 for z in (0, 1)] for y in (0, 1)] if s else [[1.0, 1.0], [1.0, 1.0]]
        own = [math.log(sum(after[y]) / sum(map(sum, after))) for y in (0, 1)] if s else log_prior
        if k == 0:
            best = own
            back.append([0, 0])
        else:
            step = [[math.log(before[y][z] / sum(before[y])) + math.log(ahead[y][z] / (ahead[0][z] + ahead[1][z])) - log_prior[y] for z in (0, 1)] for y in (0, 1)]
            choice = [max((0, 1), key=lambda y, z=z: best[y] + step[y][z]) for z in (0, 1)]
            best = [best[choice[z]] + step[choice[z]][z] + own[z] - log_prior[z] for z in (0, 1)]
            back.append(choice)
        before = after
    label = 1 if best[1] > best[0] else 0
    labels = []
    for choice in reversed(back):
        labels.append(bool(label))
        label = choice[label]
    return labels[::-1]


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flags = []
        for lines in batch.column(2).to_pylist():
            labels = _likeliest([x["stat"] for x in sorted(lines, key=lambda x: x["line_no"])])
            flags.append([k for k, label in enumerate(labels) if label])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flags, pa.list_(pa.int32()))], names=["page_id", "ingested_at", "lines"])


def _label_text_only(text_only: DataFrame, labelled: DataFrame) -> DataFrame:
    keyed = text_only.select("page_id", "ingested_at", "site", "plain_text").mapInArrow(_explode_text, "page_id bigint, ingested_at timestamp, keys array<array<bigint>>")
    lines = keyed.select("page_id", "ingested_at", F.posexplode("keys").alias("line_no", "key"))
    levels = lines.select("page_id", "ingested_at", "line_no", F.posexplode("key").alias("level", "key"))
    wanted = levels.select("key").distinct()
    at = lambda step: F.array_contains("lines", F.col("i") + step)
    seen = (
        labelled.select("lines", F.posexplode("keys").alias("i", "key"))
        .select(at(0).alias("y"), at(1).alias("z"), at(-1).alias("x"), F.explode("key").alias("key"))
    )
    both = lambda a, y, b, z: F.sum(((F.col(a) == bool(y)) & (F.col(b) == bool(z))).cast("bigint"))
    tally = {f"n{y}{z}": both("y", y, "z", z).alias(f"n{y}{z}") for y in (0, 1) for z in (0, 1)} | {f"b{y}{z}": both("x", y, "y", z).alias(f"b{y}{z}") for y in (0, 1) for z in (0, 1)}
    # counted before the join: the keys of menus and of short outlines are on every page
    stats = seen.groupBy("key").agg(*tally.values()).join(wanted, "key", "left_semi")
    enough = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") >= MIN_SEEN
    stat = F.struct("level", F.struct(*tally).alias("stat"))
    per_line = levels.join(stats, "key", "left").groupBy("page_id", "ingested_at", "line_no").agg(F.min(F.when(enough, stat)).alias("s"))
    pages = per_line.groupBy("page_id", "ingested_at").agg(F.collect_list(F.struct("line_no", F.col("s.stat").alias("stat"))).alias("lines"))
    return pages.mapInArrow(_decode_batches, "page_id bigint, ingested_at timestamp, lines array<int>")


def content_lines(pages: DataFrame) -> DataFrame:
    """``page_id, line_nos array<int>``: the lines of each page's text that are its own content.

    ``pages`` needs ``page_id, site, raw_html, plain_text, ingested_at``. One row for each page with
    text; ``line_nos`` may be empty.
    """
    source = pages.filter("page_id is not null").select("page_id", "ingested_at", "site", "raw_html", "plain_text")
    marked = source.filter("raw_html is not null").withColumn("uid", F.xxhash64("page_id", "ingested_at", "raw_html", "plain_text"))
    parsed = cut_lineage(marked.mapInArrow(_parse_batches, _PARSED))
    chosen = cut_lineage(_with_votes(parsed.drop("keys")))
    labelled = parsed.filter("keys is not null").select("uid", "keys").join(chosen.select("uid", "lines"), "uid")
    bare = _label_text_only(source.filter("raw_html is null and plain_text is not null"), labelled)
    both = chosen.filter("has_text").select("page_id", "ingested_at", "lines").unionByName(bare)
    last = both.groupBy("page_id").agg(F.max(F.struct("ingested_at", "lines")).alias("last"))
    return last.select("page_id", F.col("last.lines").alias("line_nos"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, main_text``: the content lines of each page, joined by newline ('' where there are none)."""
    lines = content_lines(pages)
    latest = pages.filter("page_id is not null and plain_text is not null").groupBy("page_id").agg(F.max_by("plain_text", "ingested_at").alias("plain_text"))
    kept = F.array_join(F.transform("line_nos", lambda i: F.get(F.split("plain_text", "\n"), i)), "\n")
    return latest.join(lines, "page_id").select("page_id", kept.alias("main_text"))
