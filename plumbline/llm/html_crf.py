"""Main-text extraction: a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
import zlib
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import map_rows
from plumbline.llm.html_blocks import Block, blocks

SAMPLE = 160  # pages of the table that are labelled for training
FEATURES = 1 << 15
ROUNDS = 150
PENALTY = 0.02
PROSE = 60  # characters of a block that counts as prose where the markup does not tell
STOCK = (
    "The harbour was quiet in the morning, and the first boats came back with little to show for the night.",
    "Nobody in the village could remember a winter in which the lake had stayed open for so long.",
    "Two of the engines had been repaired by then, and the third was to follow before the end of the month.",
)

# Words of side regions, looked for in the whole text in lower case.
CUES = {
    "rights": ("©", "(c)", "copyright", "all rights reserved"), "cookie": ("cookie", "consent", "gdpr"),
    "sign": ("subscri", "sign up", "sign in", "login", "log in", "newsletter", "register"), "share": ("share", "tweet", "facebook", "follow us"),
    "comment": ("comment", "reply", "replies"), "ad": ("advert", "sponsor", "promot"), "legal": ("privacy", "terms of", "imprint", "impressum"),
    "more": ("read more", "related", "see also", "recommended", "popular"),
}
# Elements and name words that say what a region is, for labelling pages by their structure.
MAIN = frozenset("article main".split())
ASIDE = frozenset("nav header footer aside form button select textarea label menu dialog title".split())
ASIDE_NAMES = frozenset(
    "nav navbar navigation menu header footer sidebar aside widget ad ads advert advertisement sponsored banner promo cookie notice alert popup "
    "newsletter subscribe comment comments reply respond share social breadcrumb breadcrumbs pagination related login search".split())


def structural_label(block: Block) -> int:
    """The label that the page's own markup gives a block: inside the article and in none of its side regions."""
    if block.label is not None:
        return int(block.label)
    inner = block.tags[max((i for i, t in enumerate(block.tags) if t in MAIN), default=len(block.tags)):]
    return int(bool(inner) and not ASIDE.intersection(inner) and not ASIDE_NAMES.intersection(block.names))


MAIN_BOXES = ("article", "main", 'div class="content"', 'div class="post-content entry"', 'div id="article-body"', 'section class="story"', 'div class="main text"')
SIDE_BOXES = (
    "nav", 'div class="menu"', 'ul class="navbar"', "header", 'div class="header"', "footer", 'div id="footer"', "aside", 'div class="sidebar"',
    'div class="widget"', 'div class="related"', 'div class="ad"', 'div class="advert"', 'div class="sponsored banner"', 'div class="cookie-notice"',
    'div class="notice"', 'div class="popup"', 'div class="newsletter"', 'form action="/subscribe"', 'div id="comments"', 'section class="comments"',
    'ol class="comment-list"', 'div class="share social"', 'div class="breadcrumb"', 'div class="pagination"', 'p class="notice"', 'div class="alert"',
)


def varied_page(main: list[str], other: list[str], rng: random.Random) -> str:
    """A labelled page of another layout, made of the texts of given ones; side regions hold prose as well as links."""
    def short(t: str) -> str:
        """Half of the texts at a random length, so that regions are not told by length alone."""
        return t if rng.random() < 0.5 else " ".join(t.split()[:rng.randint(2, 30)])

    def box(kind: str, inner: str, label: int) -> str:
        return f'<{kind} data-label="{label}">{inner}</{kind.split()[0]}>'

    def side() -> str:
        kind, texts = rng.choice(SIDE_BOXES), [short(t) for t in rng.sample(other, min(len(other), rng.randint(1, 3)))]
        if rng.random() < 0.4:
            inner = "<ul>" + "".join(f'<li><a href="#">{escape(" ".join(t.split()[:rng.randint(1, 4)]))}</a></li>' for t in texts * 2) + "</ul>"
        else:
            inner = "".join(f"<p>{escape(t)}</p>" if rng.random() < 0.7 else escape(t) for t in texts)
        return box(kind, inner, 0)

    body = [f"<h1>{escape(main[0])}</h1>"] + [rng.choice(("<p>{}</p>", "<p><b>{}<br>", "<blockquote>{}</blockquote>", "<p>{}", "<ul><li>{}</li></ul>")).format(escape(short(t))) for t in main[1:]]
    if rng.random() < 0.5:
        body.insert(rng.randint(1, len(body)), side())
    page = [side() for _ in range(rng.randint(1, 4))] + [box(rng.choice(MAIN_BOXES), "".join(body), 1)] + [side() for _ in range(rng.randint(1, 4))]
    for _ in range(rng.choice((0, 0, 1, 2))):
        page = ['<div class="wrapper">' if rng.random() < 0.5 else "<div>", *page, "</div>"]
    return f"<html><head><title data-label=\"0\">{escape(main[0][:60])}</title></head><body>{''.join(page)}</body></html>"


class Features:
    """Hashed features of blocks; ids of names and of contexts are remembered up to a bound."""

    def __init__(self, most: int = 1 << 16):
        self.most, self.ids, self.contexts = most, {}, {}

    def number(self, name: str) -> int:
        found = self.ids.get(name)
        if found is None:
            if len(self.ids) >= self.most:
                self.ids.clear()
            found = self.ids[name] = zlib.crc32(name.encode()) % FEATURES
        return found

    def context(self, tags: tuple[str, ...], names: frozenset[str]) -> list[int]:
        """Ancestor elements and the words of their names."""
        found = self.contexts.get((tags, names))
        if found is None:
            if len(self.contexts) >= self.most:
                self.contexts.clear()
            inner = [t for t in tags if t not in ("html", "body")]  # which pages may leave out
            named = ["bias", f"parent:{tags[-1] if tags else ''}", f"depth:{min(len(inner), 8)}", f"named:{bool(names)}"]
            named += [f"in:{t}" for t in sorted({*inner})] + [f"name:{x}" for x in sorted(names)]
            found = self.contexts[tags, names] = [self.number(x) for x in named]
        return found

    def of(self, found: list[Block]) -> list[list[int]]:
        """The features of each block of a page: where it stands and what its text looks like."""
        out = []
        last = len(found) - 1
        for i, b in enumerate(found):
            n, words, low = len(b.text), b.text.count(" ") + 1, b.text.lower()
            named = [
                f"chars:{n.bit_length()}", f"words:{words.bit_length()}", f"links:{4 * b.linked // n}", f"end:{b.text[-1] if not b.text[-1].isalnum() else 'x'}",
                f"first:{i == 0}", f"last:{i == last}", f"place:{4 * i // (last + 1)}", f"upper:{b.text[0].isupper()}", f"commas:{min(3, b.text.count(','))}",
                *[f"cue:{k}" for k, parts in CUES.items() if any(x in low for x in parts)],
            ]
            for j, side in ((i - 1, "before"), (i + 1, "after")):
                other = found[j] if 0 <= j <= last else None
                named.append(f"{side}:{other.tags[-1] if other and other.tags else ''}:{other is not None and other.tags == b.tags}")
            out.append(self.context(b.tags, b.names) + [self.number(x) for x in named])
        return out


def viterbi(unary: np.ndarray, move: np.ndarray, start: np.ndarray) -> list[int]:
    """The most probable labels of a chain: scores of label 1 over 0, transition scores and scores of the first label."""
    if not len(unary):
        return []
    off, on = float(start[0]), float(start[1] + unary[0])
    back: list[tuple[int, int]] = []
    (a, b), (c, d) = move.tolist()
    for u in unary[1:].tolist():
        to_off, to_on = (off + a, on + c), (off + b, on + d)
        back.append((int(to_off[1] > to_off[0]), int(to_on[1] > to_on[0])))
        off, on = max(to_off), max(to_on) + u
    label = int(on > off)
    path = [label]
    for step in reversed(back):
        label = step[label]
        path.append(label)
    return path[::-1]


class ChainModel:
    """Weights of a binary linear-chain CRF."""

    def __init__(self, weights: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.weights, self.move, self.start, self.features = weights, move, start, Features()

    def labels(self, found: list[Block]) -> list[int]:
        return viterbi(np.array([self.weights[f].sum() for f in self.features.of(found)]), self.move, self.start)


def fit(pages: list[list[Block]], targets: list[list[int]], rounds: int = ROUNDS, penalty: float = PENALTY) -> ChainModel:
    """Maximum penalized likelihood: expected counts by the forward-backward recursions, steps by Adam."""
    hashed = Features()
    kept = [(hashed.of(p), y) for p, y in zip(pages, targets) if p]
    n, longest = len(kept), max((len(y) for _, y in kept), default=0)
    weights, move, start = np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2)
    if not n:
        return ChainModel(weights, move, start)
    length = np.array([len(y) for _, y in kept])
    gold, mask = np.zeros((n, longest), np.int64), np.arange(longest) < length[:, None]
    cells, ids = [], []
    for i, (rows, y) in enumerate(kept):
        gold[i, :len(y)] = y
        for t, f in enumerate(rows):
            cells += [i * longest + t] * len(f)
            ids += f
    cells, ids = np.array(cells), np.array(ids)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, move, start)]
    for step in range(1, rounds + 1):
        unary = np.bincount(cells, weights[ids], n * longest).reshape(n, longest)
        score = np.stack([np.zeros_like(unary), unary], axis=2)
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + move, axis=1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], ahead[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            through = np.logaddexp.reduce(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], through, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.where(mask, np.exp(np.minimum(0, ahead[:, :, 1] + behind[:, :, 1] - total[:, None])), 0)
        pair = np.exp(ahead[:, :-1, :, None] + move + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        g = [
            np.bincount(ids, ((p - gold) * mask).ravel()[cells], FEATURES) / n + penalty * weights / n,
            (pair.sum(axis=(0, 1)) - np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & mask[:, 1:]).sum() for b in (0, 1)] for a in (0, 1)])) / n,
            np.array([(1 - p[:, 0]).sum() - (gold[:, 0] == 0).sum(), p[:, 0].sum() - (gold[:, 0] == 1).sum()]) / n,
        ]
        for x, grad, (m, v) in zip((weights, move, start), g, moments):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ChainModel(weights, move, start)


def labelled_pages(htmls: list[str | None], seed: int = 11) -> tuple[list[list[Block]], list[list[int]]]:
    """Training chains: each page labelled by its structure, and four pages of other layouts made from its texts.

    A page whose markup names no article gives its prose to made pages only, and without any prose a few stock sentences
    are used, so there is always something to fit. Real markup teaches what its article looks like; the made pages have other containers and every kind of side
    region (menus, notices, adverts, forms, comments), labelled by construction, so that regions are told by elements
    and names as well as by text.
    """
    rng = random.Random(seed)
    pages, targets = [], []
    parsed = [blocks(h) for h in htmls]
    prose = [[] if any(map(structural_label, p)) else [b.text for b in p if len(b.text) >= PROSE and 2 * b.linked < len(b.text)] for p in parsed]
    told = {t for texts in prose for t in texts}
    spare = [b.text for p in parsed for b in p if len(b.text) > 3 and b.text not in told] or ["about", "home"]

    def make(main: list[str]) -> None:
        for _ in range(4):
            made = blocks(varied_page(main, rng.sample(spare, min(12, len(spare))), rng))
            pages.append(made)
            targets.append([structural_label(b) for b in made])

    for p, texts in zip(parsed, prose):
        y = [structural_label(b) for b in p]
        if any(y):
            pages.append(p)
            targets.append(y)
            make([b.text for b, on in zip(p, y) if on])
        elif texts:
            make(texts)
    if not pages:
        make(list(STOCK))
    return pages, targets


def train(pages: DataFrame, id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> ChainModel:
    """A model fitted on at most ``sample`` pages, those with the smallest hashes of their ids."""
    rows = pages.where(F.length(html) > 0).select(html).orderBy(F.xxhash64(id), id).limit(sample).collect()
    return fit(*labelled_pages([r[0] for r in rows]))


def main_text(model: ChainModel, html: str | None) -> str:
    found = blocks(html)
    return "\n\n".join(b.text for b, on in zip(found, model.labels(found)) if on)


def extract_main_text(pages: DataFrame, model: ChainModel, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the blocks of the main text in page order joined by two line ends, and ``n_chars``.

    Pages are split into leaf blocks, a trained chain labels them by Viterbi, and those of the main text are kept whole. Row by row,
    without a shuffle; time is linear in the page.

    Defined cases: null and empty pages, and pages without text, give the empty string; malformed markup is read as far
    as it goes; repeated rows give equal results; existing columns ``text`` and ``n_chars`` are replaced; an empty table
    gives no rows.
    """
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.move, model.start))

    def extract(batch: pa.RecordBatch) -> dict:
        own = ChainModel(*sent.value)
        texts = [main_text(own, h) for h in batch.column(html).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return map_rows(pages, "text string, n_chars long", extract)
