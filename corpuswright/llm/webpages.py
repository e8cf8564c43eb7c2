"""Main text of web pages, from parser events and text-to-tag ratios.

The standard library's parser gives a page as a stream of events. Text runs between
block tags are lines; a line's ratio is its characters to its tags. Ratios are
smoothed by a Gaussian and cut at their standard deviation, which groups lines into
content and the rest. Landmarks (article, main part; the outermost counts) whose text is
mostly content are kept with all their lines, and so is the one with most content. If
the rest of the body holds more content, or there is no landmark, the region is the innermost block
with nearly all content, from its first to its last content line; unlinked lines next
to these are kept, too. Parts that are never article text (navigation, asides, forms,
scripts, adverts, comments and so on) are left out by their tags, roles and
whole class names, which do not count on landmarks. Such a part comes back if it holds
most of the page's content, but not from outside of the landmarks where there are any.
Scripts, controls, media and hidden elements never do.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices

# Names of the markup (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset(
    "audio button canvas datalist head iframe math noscript object script select style svg template textarea title video".split()
)
LEFT_OUT = frozenset("aside dialog footer form menu nav".split())
WRAPPERS = frozenset("html body".split())
LANDMARKS = frozenset("article main".split())
IN_HEAD = frozenset("html head title".split())
# Elements that end where one of these starts, and where the search for them stops.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "option": (("option",), ("select",)),
} | dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot"), ("table",)))
LEFT_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu navigation search".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter "
    "notice notices paywall popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored "
    "subscribe subscription toolbar widget".split()
)
# Words that may stand beside them in a class name, as in share-bar.
PARTS = frozenset(
    "area article articles bar block bottom box btn button buttons container entry icons inner item items links list main "
    "page panel post posts primary secondary section site top wrap wrapper".split()
)
HEADER_NAMES = frozenset("header site-header page-header top-header".split())
_NAME = re.compile(r"[a-z0-9]+")
SIGMA, RADIUS = 1.0, 2
LONG_LINE, REGION_SHARE = 3.0, 0.9


@lru_cache(10_000)
def left_out_name(name: str) -> bool:
    """Whether a class or id as a whole, not a word in it, names a part to leave out."""
    words = set(_NAME.findall(name))
    return name in HEADER_NAMES or bool(words & LEFT_OUT_NAMES) and words <= LEFT_OUT_NAMES | PARTS


class _Lines(HTMLParser):
    """Collects lines with their tags, linked characters, left-out element, landmark and
    block.

    Blocks are kept on a stack, other elements only where they are left out or stand in
    one of their name; an element ends at the latest with one that encloses it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.links = 0
        self.linked = False
        # Open elements with the state outside of each.
        self.stack: list[tuple[str, tuple[bool, int, int, int]]] = []
        self.open: dict[str, int] = {}
        self.never, self.out, self.landmark, self.block = False, 0, 0, 0
        # Enclosing block of each block, enclosing left-out element of each such element,
        # left-out element around each landmark.
        self.blocks, self.outs, self.landmarks = [0], [0], [0]

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.links, self.out, self.landmark, self.block))
            self.tags = self.links = 0
        self.text.clear()

    def _pop(self) -> None:
        tag, (self.never, self.out, self.landmark, self.block) = self.stack.pop()
        self.open[tag] -= 1
        if tag in BLOCKS:
            self.linked = False

    def _close(self, tag: str) -> None:
        """End the innermost open element of this name and what stands open in it."""
        while self.stack[-1][0] != tag:
            self._pop()
        self._pop()

    def _imply_ends(self, tag: str) -> None:
        """End the elements that a block ends by starting."""
        if self.open.get("head") and tag not in IN_HEAD:
            self._close("head")
        if self.open.get("p"):
            for name, _ in reversed(self.stack):
                if name in BLOCKS:
                    if name == "p":
                        self._close("p")
                    break
        ends, within = IMPLIED_ENDS.get(tag, ((), ()))
        if any(self.open.get(name) for name in ends):
            for name, _ in reversed(self.stack):
                if name in within:
                    break
                if name in ends:
                    self._close(name)
                    break

    def _kind(self, tag: str, attrs) -> str:
        """Whether an element is never text, left out, a landmark or none of these."""
        landmark = tag in LANDMARKS or ("role", "main") in attrs
        left_out = tag in LEFT_OUT or tag == "header" and not self.landmark
        if tag in NEVER:
            return "never"
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "never"
            if name in ("class", "id"):
                left_out = left_out or any(map(left_out_name, value.split()))
            elif name == "role":
                left_out = left_out or value in LEFT_OUT_ROLES
        if landmark:
            return "landmark"
        return "left out" if left_out and tag not in WRAPPERS else ""

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if tag not in VOID:
                self._imply_ends(tag)
        elif tag == "a":
            self.linked = any(name == "href" for name, _ in attrs)
        if tag in VOID:
            return
        kind = self._kind(tag, attrs)
        if not (kind or tag in BLOCKS or self.open.get(tag)):
            return
        if kind:
            self._end_line()
        self.stack.append((tag, (self.never, self.out, self.landmark, self.block)))
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in BLOCKS:
            self.blocks.append(self.block)
            self.block = len(self.blocks) - 1
        if kind == "never":
            self.never = True
        elif kind == "left out":
            self.outs.append(self.out)
            self.out = len(self.outs) - 1
        elif kind == "landmark" and not self.landmark:
            self.landmarks.append(self.out)
            self.landmark = len(self.landmarks) - 1

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag in BLOCKS:
            self._end_line()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or self.open.get(tag):
            self._end_line()
        if tag == "a":
            self.linked = False
        if self.open.get(tag):
            self._close(tag)

    def handle_data(self, data):
        if not self.never:
            self.text.append(data)
            if self.linked:
                self.links += len(data.strip())


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios after a Gaussian over neighbouring lines."""
    step = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(step**2) / (2 * SIGMA**2))
    near = np.convolve(ratios, kernel, "full")[RADIUS : RADIUS + len(ratios)]
    return near / np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS : RADIUS + len(ratios)]


def content_lines(size: np.ndarray, tags: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Which lines are content. Ratios beyond ``LONG_LINE`` medians of the unlinked lines
    count as that, so that one long line does not raise the threshold for the others."""
    ratio = size / np.maximum(1, tags)
    plain = links <= size / 2
    if plain.any():
        ratio = np.minimum(ratio, LONG_LINE * np.median(ratio[plain]))
    near = smoothed(ratio)
    content = near >= min(near.std(), near.max())
    return content & plain if (content & plain).any() else content


def body_lines(free: np.ndarray, mass: np.ndarray, plain: np.ndarray, block: np.ndarray, blocks: list[int]) -> np.ndarray:
    """The lines of the innermost block that holds nearly all content, from its first to
    its last content line, and the unlinked lines next to these."""
    within = np.bincount(block, mass, len(blocks)).tolist()
    for i in range(len(blocks) - 1, 0, -1):
        within[blocks[i]] += within[i]
    inner = max(i for i in range(len(blocks)) if not i or within[i] > REGION_SHARE * within[0])
    inside = [False] * len(blocks)
    for i in range(inner, len(blocks)):
        inside[i] = i == inner or inside[blocks[i]]
    region = np.flatnonzero(free & np.array(inside)[block])
    at = np.flatnonzero(mass[region])
    first, last = (at[0], at[-1]) if len(at) else (0, len(region) - 1)
    while first > 0 and plain[region[first - 1]]:
        first -= 1
    while last < len(region) - 1 and plain[region[last + 1]]:
        last += 1
    chosen = np.zeros(len(free), bool)
    chosen[region[first : last + 1]] = True
    return chosen


def main_text(page: str) -> str:
    """Main text of a page, its blocks joined by one space; empty if there is none."""
    parser = _Lines()
    parser.feed(page)
    parser.close()
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(line[0]) for line in lines], float)
    tags, links, out, landmark, block = np.array([line[1:] for line in lines]).T
    content = content_lines(size, tags, links)
    mass, plain = size * content, links <= size / 2
    around = np.array(parser.landmarks)[landmark]
    restored: set[int] = set()

    def outermost(innermost: np.ndarray) -> np.ndarray:
        """Outermost left-out element of each line that is not restored; 0 for none."""
        found = [0]
        for i, parent in enumerate(parser.outs[1:], 1):
            found.append(found[parent] or (0 if i in restored else i))
        return np.array(found)[innermost]

    # Landmarks inside left-out elements count where these hold more content than all that
    # is not left out; so does a left-out element with most of the page's content, which
    # must stand in a landmark where there is one.
    left = outermost(out)
    hidden = (landmark > 0) & (out == around)
    if not (hidden & (left == 0)).any() and mass[hidden].sum() > mass[left == 0].sum():
        for i in set(around[hidden].tolist()):
            while i:
                restored.add(i)
                i = parser.outs[i]
        left = outermost(out)
    inside = (landmark > 0) & (outermost(around) == 0)
    allowed = inside if inside.any() else np.ones(len(lines), bool)
    while (held := np.bincount(left, mass * allowed)[1:]).max(initial=0) > mass.sum() / 2:
        restored.add(int(held.argmax()) + 1)
        left = outermost(out)
    free = left == 0
    if not free.any():
        return ""
    marked = free & (landmark > 0)
    if marked.any() and mass[marked].sum() >= mass[free & (landmark == 0)].sum():
        # Landmarks most of whose text is content, and the one with most of it, as a whole.
        text = np.bincount(landmark, size * marked)
        held = np.bincount(landmark, mass * marked)
        passing = held > text / 2
        passing[(held + 1e-6 * text)[1:].argmax() + 1] = True
        chosen = marked & passing[landmark]
    else:
        chosen = body_lines(free, mass * free, plain, block, parser.blocks)
    return " ".join(line[0] for line, keep in zip(lines, chosen) if keep)


def extract(df: DataFrame, key: str = "page_id", column: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns ``carry``, ``text`` and ``n_chars`` (code points) of every
    row, from the whole page.

    Character references are decoded; white space inside a block becomes one space.
    A null or empty page, or one without main text, gives an empty text. Repeated rows
    each give a row; other columns are not read; an empty table gives an empty table.
    """
    rows = df.select(F.col(key).alias("c0"), *[F.col(c).alias(f"c{i + 2}") for i, c in enumerate(carry)], F.col(column).cast("string").alias("c1"))
    schema = T.StructType(
        [df.schema[key], *[df.schema[c] for c in carry], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    )

    def run(batches):
        for part in slices(batches, "c1"):
            texts = [main_text(p) if p else "" for p in part.column("c1").to_pylist()]
            found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], schema.names)

    return rows.mapInArrow(run, schema)
