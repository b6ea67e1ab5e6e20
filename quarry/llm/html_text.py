"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is read into its leaf blocks in page order: runs of text between the
boundaries of block elements and line breaks.  A block's features are the tags
of its ancestors, the words in their class and id names, and traits of its text
(length, links, punctuation, place).  Two labels, main text or not, are scored
by those features and by the pair of neighbouring labels.  Training maximises
the regularised likelihood of labelled pages (``html_pages``) by full-batch
gradient steps; decoding is Viterbi.  The model is a few thousand floats, bounded
by the feature space, and is broadcast.

Scripts, styles, comments in the markup and the head are never text.  Defined
results: null or empty html gives the empty text; broken or cut-off markup is
read as far as it goes; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import html_pages
from .common import in_arrow, text_of

# Elements of HTML.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIP = frozenset("script style head title noscript template svg math textarea iframe object canvas audio video".split())
#: What an opening tag closes by itself: the tag, and where the search stops.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
    **{t: {"p"} for t in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split()},
}
BITS = 12
WIDTH = 1 << BITS
_NAME = re.compile(r"[a-zA-Z]+")
_SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("chain", "names", "linked", "text")

    def __init__(self, chain, names, text, linked):
        self.chain, self.names, self.text, self.linked = chain, names, text, linked


class _Reader(HTMLParser):
    """Leaf blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.run: list[str] = []
        self.linked = self.skip = self.anchors = 0

    def flush(self) -> None:
        if self.run:
            text = _SPACE.sub(" ", "".join(self.run)).strip()
            if text:
                self.blocks.append(Block(tuple(t for t, _ in self.stack), tuple({n for _, names in self.stack for n in names}), text, self.linked / max(1, sum(map(len, self.run)))))
        self.run, self.linked = [], 0

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.skip -= tag in SKIP
        self.anchors -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in ("body", "main", "article", "div", "nav", "header") and self.skip:
            while any(t == "head" for t, _ in self.stack):
                self._pop()
        if tag in CLOSES:
            closes = CLOSES[tag]
            while self.stack and self.stack[-1][0] in closes:
                self._pop()
            # an inline element left open inside a paragraph does not keep it open
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k][0] not in BLOCK:
                k -= 1
            if k >= 0 and k < len(self.stack) - 1 and self.stack[k][0] in closes:
                while len(self.stack) > k:
                    self._pop()
        if tag in VOID:
            return
        names = tuple(w.lower() for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME.findall(v))
        self.stack.append((tag, names))
        self.skip += tag in SKIP
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if any(t == tag for t, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.skip:
            self.run.append(data)
            if self.anchors:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    reader = _Reader()
    try:
        reader.feed(html)
        reader.close()
    except AssertionError:  # the parser's own, on hopeless markup; what was read stands
        pass
    reader.flush()
    return reader.blocks


@lru_cache(1 << 16)
def _place(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (WIDTH - 1)


@lru_cache(1 << 14)
def _context(chain: tuple[str, ...], names: tuple[str, ...]) -> tuple[int, ...]:
    tags = [t for t in chain if t not in ("html", "body")]
    out = {f"tag {t}" for t in tags} | {f"name {n}" for n in names} | {f"part {n[:5]}" for n in names}
    leaf = [t for t in tags if t in BLOCK][-2:]
    out.add("leaf " + ">".join(leaf))
    return tuple(sorted({_place(f) for f in out}))


def _traits(b: Block, i: int, n: int) -> list[str]:
    text = b.text
    size, words = len(text), text.count(" ") + 1
    ends = text[-1] in ".!?…\"'”»。"
    leaf = next((t for t in reversed(b.chain) if t in BLOCK), "")
    out = [f"size {min(size, 2000).bit_length()}", f"link {int(b.linked * 4)}", f"ends {ends}", f"size {min(size, 2000).bit_length()} ends {ends} leaf {leaf}", f"stops {min(4, sum(map(text.count, '.!?,')))}"]
    out.append(f"first {leaf}" if i == 0 else "last" if i == n - 1 else "inside")
    if "©" in text:
        out.append("copyright")
    if text[0].isdigit() and words < 5:
        out.append("count")
    return out


def features(found: list[Block]) -> list[tuple[int, ...]]:
    return [_context(b.chain, b.names) + tuple(_place(t) for t in _traits(b, i, len(found))) for i, b in enumerate(found)]


class Model:
    """Emission weights for the label 'main text' and a 2 x 2 transition matrix, with start scores."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.emit, self.move, self.start = emit, move, start

    def decode(self, rows: list[tuple[int, ...]]) -> list[int]:
        """Viterbi."""
        if not rows:
            return []
        (aa, ab), (ba, bb) = self.move.tolist()
        emit = self.emit
        e = [float(emit[list(r)].sum()) for r in rows]
        a, b = float(self.start[0]), float(self.start[1]) + e[0]
        back = []
        for x in e[1:]:
            to_a, to_b = a + aa >= b + ba, a + ab >= b + bb
            back.append((0 if to_a else 1, 0 if to_b else 1))
            a, b = (a + aa if to_a else b + ba), (a + ab if to_b else b + bb) + x
        label = int(b > a)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def labelled(html: str) -> tuple[list[tuple[int, ...]], list[int]]:
    """Features and labels of a marked page; a block is main text if its first mark says so."""
    found = blocks(html)
    marks = [b.text[:1] == "\x01" for b in found]
    for b in found:
        b.text = b.text.replace("\x01", "").replace("\x02", "") or "."
    return features(found), [int(m) for m in marks]


def train(marked: list[str], rounds: int = 120, rate: float = 0.25, l2: float = 1e-4) -> Model:
    """Gradient ascent (with momentum) on the mean log-likelihood, forwards and backwards over all pages at once."""
    data = [x for x in map(labelled, marked) if x[0]]
    pages, longest = len(data), max(len(y) for _, y in data)
    rows, cols, where = [], [], []
    gold, mask = np.zeros((pages, longest), int), np.zeros((pages, longest), bool)
    for p, (xs, ys) in enumerate(data):
        for i, (x, y) in enumerate(zip(xs, ys)):
            gold[p, i], mask[p, i] = y, True
            rows += [len(where)] * len(x)
            cols += x
            where.append((p, i))
    rows, cols, at = np.array(rows), np.array(cols), np.array(where).T
    total = mask.sum()
    both = mask[:, 1:]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    seen_start = np.bincount(gold[:, 0], minlength=2).astype(float)
    emit, move, start = np.zeros(WIDTH), np.zeros((2, 2)), np.zeros(2)
    pace = [np.zeros_like(x) for x in (emit, move, start)]
    size = [np.full_like(x, 1e-6) for x in (emit, move, start)]
    for _ in range(rounds):
        e = np.zeros((pages, longest))
        e[at[0], at[1]] = np.bincount(rows, emit[cols], len(where))
        ahead = np.zeros((pages, longest, 2))
        ahead[:, 0] = start
        ahead[:, 0, 1] += e[:, 0]
        for i in range(1, longest):
            s = ahead[:, i - 1, :, None] + move
            ahead[:, i] = np.logaddexp(s[:, 0], s[:, 1])
            ahead[:, i, 1] += e[:, i]
        back = np.zeros((pages, longest, 2))
        for i in range(longest - 2, -1, -1):
            nxt = back[:, i + 1].copy()
            nxt[:, 1] += e[:, i + 1]
            s = move + nxt[:, None, :]
            back[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0)
        whole = np.logaddexp(*np.moveaxis(ahead[:, 0] + back[:, 0], 1, 0))
        p1 = np.exp(ahead[:, :, 1] + back[:, :, 1] - whole[:, None])
        gap = np.where(mask, gold - p1, 0)
        g_emit = np.bincount(cols, gap[at[0], at[1]][rows], WIDTH)
        want = np.zeros((2, 2))
        for u in (0, 1):
            for v in (0, 1):
                s = ahead[:, :-1, u] + move[u, v] + back[:, 1:, v] + (e[:, 1:] if v else 0) - whole[:, None]
                want[u, v] = np.exp(s[both]).sum()
        p0 = np.exp(ahead[:, 0] + back[:, 0] - whole[:, None])
        for k, (x, g) in enumerate(((emit, g_emit), (move, seen_move - want), (start, seen_start - p0.sum(0)))):
            g = g / total - l2 * x
            size[k] = 0.99 * size[k] + 0.01 * g * g
            pace[k] = 0.9 * pace[k] + 0.1 * g
            x += rate * pace[k] / (np.sqrt(size[k]) + 1e-4)
    return Model(emit, move, start)


@lru_cache
def trained(n_pages: int = 400, seed: int = 1) -> Model:
    return train(html_pages.pages(n_pages, seed))


def main_text(html: str, model: Model) -> str:
    found = blocks(html) if html else []
    return "\n".join(b.text for b, y in zip(found, model.decode(features(found))) if y)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), model: Model | None = None) -> DataFrame:
    """(id, *keep, text) for every row."""
    model = model or trained()
    shared = pages.sparkSession.sparkContext.broadcast((model.emit, model.move, model.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = pa.array([main_text(h.as_py(), own) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*batch.schema.names[:-1], "text"])

    rows = pages.select(F.col(id_col).alias("id"), *keep, text_of(html_col).alias("__html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.transform(in_arrow, run, fields + ", text string")
