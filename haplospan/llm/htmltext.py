"""Main text of pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with the path of its open elements.
A bidirectional LSTM in numpy reads, for each block, learned vectors of its path (tags, and the words of class, id and role),
of its hashed words (the mean over all words of the block), and a few numbers; so each block is classified with the whole page as context.  Blocks labelled as
main text are joined in page order.

Training takes a bounded sample of pages (SAMPLE, chosen by a hash of the url, of each the first SAMPLE_CHARS characters and LEAVES
blocks; prediction reads whole pages).  Pages that mark their article label
their own blocks by their elements, once as they are and once with the marks taken away: the article in plain elements, its names
dropped or replaced by names made up.  Further pages are composed of the sampled blocks, with text and surroundings dealt
out anew, so that structure and context decide, not words: articles in containers with known, unknown or no names, menus, headers,
sidebars, notices, adverts, forms, reader comments and footers.

The parser is linear in the page: it keeps the places of the open elements by tag, and the path of a block is the set of the words
of its open elements, kept as counts.

Only script, style and template are raw text, as in HTML also to the end of the page where they are not closed; the elements of formulas, drawings
and fallback text (math, svg, object, canvas, iframe, noscript) are inline elements like others.

Defined cases: null or empty html has no text; html without tags is one block; repeated pages give repeated rows; null ids and
urls are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300
SAMPLE_CHARS = 60_000
COMPOSED = 900
PATHS, WORDS = 4096, 512
PIECE = 65_536
PATH_SIZE, WORD_SIZE, HIDDEN = 16, 4, 16
NUMBERS = 6
STEPS = 300
BATCH = 32
RATE = 0.01
LEAVES = 96

# Elements by their part in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template".split())
EMBEDDED = set("math svg object canvas iframe noscript".split())
FOREIGN = set(
    "mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts "
    "none mtable mtr mtd maction semantics annotation annotation-xml g text tspan textpath defs symbol use path rect circle ellipse line polyline polygon desc metadata".split()
)
INLINE = EMBEDDED | FOREIGN | set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark meter output progress q s samp select small span "
    "strike strong sub sup time tt u var wbr button textarea option".split()
)
CLOSED_BY = {"p": set("p div ul ol li table section article nav aside header footer form h1 h2 h3 h4 h5 h6 blockquote pre figure main dl hr address fieldset details".split())}
CLOSED_BY |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"head", "body"}}
CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SCOPES = set("ul ol dl table tr div section article nav aside header footer form body main blockquote".split())

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def path_words(tag: str, attributes: str) -> list[str]:
    out = [tag]
    if attributes:
        for found in NAMES.finditer(attributes):
            out += ["." + w.lower() for w in NAME_WORD.findall(found[1] or found[2] or found[3] or "") if not w[0].isdigit()]
    return out


class Open:
    """The open elements of a page: places by tag, those of block elements, those that may end an element, and the words of their paths."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list]] = []
        self.by_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.ends: list[int] = []
        self.words: dict = {}

    def push(self, tag: str, words: list) -> None:
        at = len(self.stack)
        self.stack.append((tag, words))
        self.by_tag.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPES or tag in CLOSED_BY:
            self.ends.append(at)
        for w in words:
            self.words[w] = self.words.get(w, 0) + 1

    def close_from(self, at: int) -> None:
        while len(self.stack) > at:
            tag, words = self.stack.pop()
            self.by_tag[tag].pop()
            for places in (self.blocks, self.ends):
                if places and places[-1] == len(self.stack):
                    places.pop()
            for w in words:
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]

    def end(self, tag: str) -> None:
        """A closing tag; one of an inline element ends none beyond the innermost block."""
        places = self.by_tag.get(tag)
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.close_from(places[-1])

    def in_link(self) -> bool:
        """Whether a link is open inside the innermost block, at any depth, or not far around it: one left open farther out is no sign of a link."""
        places = self.by_tag.get("a")
        return bool(places) and (places[-1] >= len(self.stack) - 4 or not self.blocks or places[-1] > self.blocks[-1])

    def make_room(self, tag: str) -> None:
        """Ends the element that an opening tag ends."""
        for at in reversed(self.ends):
            open_tag = self.stack[at][0]
            if tag in CLOSED_BY.get(open_tag, ()):
                self.close_from(at)
                return
            if open_tag in SCOPES:
                return


def blocks_of(page: str | None, place=str) -> list[tuple[tuple, str, int]]:
    """Path words, text and characters in links of every leaf block of a page, in order.  place: what stands for a word in paths."""
    if not page:
        return []
    out: list[tuple[tuple, str, int]] = []
    inside = Open()
    text: list[str] = []
    inline: dict = {}
    links = 0

    def close_block() -> None:
        nonlocal links
        joined = " ".join("".join(text).split())
        if joined:
            out.append((tuple(inside.words | inline), joined, links))
        text.clear()
        inline.clear()
        links = 0

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            piece = page[at:start]
            text.append(entities.unescape(piece) if "&" in piece else piece)  # each by itself: no reference goes over a tag
            if inside.in_link():
                links += start - at
        if start == end:
            break
        m = TAG.match(page, start)
        if m is None:
            text.append("<")
            at = start + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if not m[3].rstrip().endswith("/"):
                close = CLOSE[tag].search(page, at)
                at = close.end() if close else end
            continue
        if tag not in INLINE:
            close_block()
        elif not m[1] and tag not in FOREIGN:
            inline[place(tag)] = 1
        if m[1]:
            inside.end(tag)
        else:
            inside.make_room(tag)
            if tag not in VOID and not (tag in EMBEDDED | FOREIGN and m[3].rstrip().endswith("/")):
                inside.push(tag, [place(w) for w in path_words(tag, m[3])])
    close_block()
    return out


# ---------------------------------------------------------------- numbers of a block


@functools.lru_cache(maxsize=20_000)
def path_place(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % PATHS


def path_ids(path: tuple) -> tuple[int, ...]:
    """Places of the words of a path; places stand for themselves."""
    return tuple(sorted({w if isinstance(w, int) else path_place(w) for w in path}))


def word_counts(text: str) -> Counter[int]:
    """How often each word place occurs among all words of a block, counted piece by piece."""
    counts: Counter[int] = Counter()
    at = 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        counts.update([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in text[at:end].lower().split()])
        at = end
    return counts


def described(page_blocks: list[tuple[tuple[str, ...], str, int]]) -> tuple[list[tuple[int, ...]], list[Counter[int]], np.ndarray]:
    """Path places, counts of word places and numbers of each block."""
    n = len(page_blocks)
    numbers = np.zeros((n, NUMBERS))
    words = []
    for k, (path, text, links) in enumerate(page_blocks):
        words.append(word_counts(text))
        numbers[k] = (np.log1p(len(text)) / 5, min(1.0, links / max(1, len(text))), k / n, (n - k) / n, float(text[-1] in ".!?…"), len(set(path)) / 8)
    return [path_ids(p) for p, _, _ in page_blocks], words, numbers


class Labeller:
    """A bidirectional LSTM over the blocks of a page, with a logistic output."""

    NAMES = ("paths", "words", "ahead_in", "ahead_own", "ahead_bias", "behind_in", "behind_own", "behind_bias", "out", "out_bias")

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        of = {"paths": rng.normal(0, 0.3, (PATHS, PATH_SIZE)), "words": rng.normal(0, 0.1, (WORDS, WORD_SIZE))}
        for side in ("ahead", "behind"):
            of[f"{side}_in"] = rng.normal(0, 1 / np.sqrt(size), (size, 4 * HIDDEN))
            of[f"{side}_own"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            of[f"{side}_bias"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        of |= {"out": rng.normal(0, 0.3, (2 * HIDDEN + PATH_SIZE, 1)), "out_bias": np.zeros(1)}
        self.of: dict[str, np.ndarray] = of

    # pages side by side: time, page, size

    def inputs(self, pages: list) -> tuple[np.ndarray, np.ndarray, tuple]:
        steps, n = max(len(p[0]) for p in pages), len(pages)
        mask = np.zeros((steps, n))
        numbers = np.zeros((steps, n, NUMBERS))
        flat: dict[str, list] = {"path_at": [], "path": [], "word_at": [], "word": [], "times": []}
        for k, (paths, words, values) in enumerate(pages):
            mask[: len(paths), k] = 1
            numbers[: len(paths), k] = values
            for t, (p, w) in enumerate(zip(paths, words, strict=True)):
                flat["path_at"] += [t * n + k] * len(p)
                flat["path"] += p
                flat["word_at"] += [t * n + k] * len(w)
                flat["word"] += w.keys()
                flat["times"] += w.values()
        index = {k: np.array(v, dtype=np.int64) for k, v in flat.items()}
        path = self.pooled("paths", index["path"], index["path_at"], steps * n, root=True)
        word = self.pooled("words", index["word"], index["word_at"], steps * n, times=index["times"])
        x = np.concatenate([path[0].reshape(steps, n, -1), word[0].reshape(steps, n, -1), numbers], axis=2)
        return x, mask, (index, path[1], word[1])

    def pooled(self, name: str, ids: np.ndarray, at: np.ndarray, rows: int, root: bool = False, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Means of vectors by row (sums over the square root of their number for paths); a vector counts as often as times says."""
        table = self.of[name]
        count = np.maximum(1, np.bincount(at, weights=times, minlength=rows))
        scale = 1 / np.sqrt(count) if root else 1 / count
        sums = np.stack([np.bincount(at, weights=table[ids, k] if times is None else table[ids, k] * times, minlength=rows) for k in range(table.shape[1])], axis=1)
        return sums * scale[:, None], scale

    def side(self, name: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, kept = np.zeros((steps, n, HIDDEN)), []
        gates_in = x @ self.of[f"{name}_in"] + self.of[f"{name}_bias"]
        own = self.of[f"{name}_own"]
        for t in range(steps) if name == "ahead" else range(steps - 1, -1, -1):
            z = gates_in[t] + h @ own
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new = f * c + i * g
            wide = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, wide, m))
            c = m * new + (1 - m) * c
            h = m * (o * wide) + (1 - m) * h
            out[t] = h
        return out, kept

    def scores(self, pages: list, keep: bool = False):
        x, mask, more = self.inputs(pages)
        ahead, kept_a = self.side("ahead", x, mask, keep)
        behind, kept_b = self.side("behind", x, mask, keep)
        both = np.concatenate([ahead, behind, x[:, :, :PATH_SIZE]], axis=2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.of["out"] + self.of["out_bias"], -30, 30)[:, :, 0]))
        return (p, mask, x, more, both, kept_a, kept_b) if keep else (p, mask)

    def slopes(self, pages: list, gold: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradients of the mean log-loss, by back-propagation through time."""
        p, mask, x, (index, path_scale, word_scale), both, kept_a, kept_b = self.scores(pages, keep=True)
        y = np.zeros_like(p)
        for k, g in enumerate(gold):
            y[: len(g), k] = g
        d = ((p - y) * mask / mask.sum())[:, :, None]
        out = {"out": np.einsum("tnk,tno->ko", both, d), "out_bias": d.sum(axis=(0, 1))}
        d_both = d @ self.of["out"].T
        d_x = np.zeros_like(x)
        d_x[:, :, :PATH_SIZE] += d_both[:, :, 2 * HIDDEN :]
        for name, kept, at in (("ahead", kept_a, 0), ("behind", kept_b, HIDDEN)):
            own, d_own = self.of[f"{name}_own"], np.zeros_like(self.of[f"{name}_own"])
            d_z = np.zeros((*p.shape, 4 * HIDDEN))
            d_h, d_c = np.zeros((p.shape[1], HIDDEN)), np.zeros((p.shape[1], HIDDEN))
            for t, h, c, i, f, o, g, wide, m in reversed(kept):
                d_h = d_h + d_both[t, :, at : at + HIDDEN]
                here = m * d_h
                d_new = m * d_c + here * o * (1 - wide**2)
                z = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), here * wide * o * (1 - o), d_new * i * (1 - g**2)], axis=1)
                d_z[t] = z
                d_own += h.T @ z
                d_h = z @ own.T + (1 - m) * d_h
                d_c = d_new * f + (1 - m) * d_c
            out |= {f"{name}_own": d_own, f"{name}_in": np.einsum("tnk,tnz->kz", x, d_z), f"{name}_bias": d_z.sum(axis=(0, 1))}
            d_x += d_z @ self.of[f"{name}_in"].T
        flat = d_x.reshape(-1, d_x.shape[2])
        for name, low, size, ids, places, scale in (
            ("paths", 0, PATH_SIZE, index["path"], index["path_at"], path_scale[index["path_at"]]),
            ("words", PATH_SIZE, WORD_SIZE, index["word"], index["word_at"], word_scale[index["word_at"]] * index["times"]),
        ):
            share = flat[places, low : low + size] * scale[:, None]
            out[name] = np.stack([np.bincount(ids, weights=share[:, k], minlength=len(self.of[name])) for k in range(size)], axis=1)
        return out

    def fit(self, pages: list, gold: list[np.ndarray], steps: int = STEPS, seed: int = 0) -> None:
        """Adam on batches of pages."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.of.items()}
        second = {k: np.zeros_like(v) for k, v in self.of.items()}
        order: list[int] = []
        for step in range(1, steps + 1):
            if len(order) < BATCH:
                order += rng.permutation(len(pages)).tolist()
            some, order = order[:BATCH], order[BATCH:]
            for name, slope in self.slopes([pages[k] for k in some], [gold[k] for k in some]).items():
                first[name] = 0.9 * first[name] + 0.1 * slope
                second[name] = 0.99 * second[name] + 0.01 * slope**2
                self.of[name] -= RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)


# ---------------------------------------------------------------- training data

# Element and class words that mark blocks of a page.
MAIN_PATHS = ["article", "main", "div.content", "div.post-content", "div.entry-content", "div.article-body", "section.story", "div#main", "div.text", "main.page article", "div.post", "section.content article"]
BESIDE = {
    "menu": ["nav ul li a", "div.menu ul li a", "div.navbar a", "ul.nav li a", "header nav ul li a", "div.breadcrumb a"],
    "header": ["header", "div.header", "header h2", "div#masthead", "div.site-title", "header.site-header p"],
    "sidebar": ["aside", "aside p", "div.sidebar p", "div.sidebar ul li a", "aside.related ul li a", "div.widget p", "section.related li a", "div.side-column p"],
    "notice": ["div.cookie", "div.cookie-notice p", "div.notice p", "div.banner", "div.consent p", "div.alert", "section.newsletter p", "div.popup p", "div.subscribe p"],
    "advert": ["div.ad", "div.ads p", "div.advert p", "div.sponsored p", "section.promo p", "div.advertisement", "aside.ad p", "ins.adsbygoogle"],
    "form": ["form label", "form p", "form.search button", "div.login form label", "form.contact p label", "form fieldset legend"],
    "comments": ["div.comments p", "div#comments div.comment p", "section.comments article.comment p", "ul.comment-list li p", "div.reader-comments p", "section#comments div.reply p", "ol.commentlist li div.comment-body p", "section.comments h3"],
    "footer": ["footer", "footer p", "div.footer", "footer ul li a", "div#footer p", "div.copyright", "footer.site-footer small"],
}
MARKS = {"section", "nav", "aside", "header", "footer"}
ORDER = ("notice", "header", "menu", "advert", None, "form", "comments", "sidebar", "advert", "footer")


def spelled(path: str) -> tuple[str, ...]:
    """``div.post-content p`` as path words."""
    out: list[str] = []
    for element in path.split():
        tag, *names = re.split(r"[.#]", element)
        out += [tag, *("." + w.lower() for n in names for w in NAME_WORD.findall(n))]
    return tuple(out)


def marked(page_blocks: list) -> np.ndarray | None:
    """Labels of the blocks of a page that marks its article; else None."""
    tags = [set(p) for p, _, _ in page_blocks]
    main = np.array([bool({"article", "main"} & t) for t in tags], dtype=bool)
    if not main.any():
        return None
    beside = {"nav", "aside", "footer", "form", "title"} | {"." + w for w in "ad ads advert advertisement sponsored promo sidebar related comment comments notice cookie banner newsletter subscribe share social menu".split()}
    return (main & ~np.array([bool(beside & t) for t in tags], dtype=bool)).astype(np.float64)


def made_up(rng: np.random.Generator) -> str:
    return "." + "".join("bcdfghklmnprstvwaeiou"[int(i)] for i in rng.integers(21, size=int(rng.integers(2, 10))))


def renamed(path: tuple[str, ...], rng: np.random.Generator, plain: float, drop: float, change: float) -> tuple[str, ...]:
    """A path whose elements may become plain ones, and whose names may be dropped or made up."""
    if rng.random() < plain:
        path = tuple("div" if w in {"article", "main", "section"} else w for w in path)
    fate = rng.random()
    if fate < drop:
        return tuple(w for w in path if w[0] != ".")
    if fate < drop + change:
        return tuple(w for w in path if w[0] != ".") + tuple(made_up(rng) for _ in range(int(rng.integers(1, 4))))
    return path


def without_marks(blocks: list, labels: np.ndarray, rng: np.random.Generator) -> list:
    """Blocks of a page that marks its article, with the marks taken away: those of the article, or all of the page."""
    bare, names = rng.random() < 0.3, [] if rng.random() < 0.35 else [made_up(rng) for _ in range(int(rng.integers(1, 4)))]
    out = []
    for (path, text, links), main in zip(blocks, labels, strict=True):
        inner = tuple("div" if w in ({"article", "main"} | MARKS if bare else {"article", "main"}) else w for w in path if not (w[0] == "." and (main or bare)))
        out.append((inner + (tuple(names) if not bare and {"article", "main"} & set(path) else ()), text, links))
    return out


def composed(texts: list[str], rng: np.random.Generator, n: int = COMPOSED) -> tuple[list, list[np.ndarray]]:
    """Pages of sampled blocks dealt out anew, and their labels."""
    pages, gold = [], []

    def text(short: bool) -> str:
        t = texts[int(rng.integers(len(texts)))]
        words = t.split()
        if short:
            return " ".join(words[: int(rng.integers(1, 6))])
        at = int(rng.integers(max(1, len(words) - 4)))
        return " ".join(words[at : at + int(rng.integers(2, 90))])

    for _ in range(n):
        body = ("html", "body") + (("div", *[".wrapper", ".page", ".container"][: int(rng.integers(0, 2))]) if rng.random() < 0.5 else ())
        blocks, labels = [(("html", "head", "title"), text(True), 0)], [0.0]
        for part in ORDER:
            if part is None:
                container = renamed(spelled(MAIN_PATHS[int(rng.integers(len(MAIN_PATHS)))]), rng, 0.35, 0.2, 0.35)
                for k in range(int(rng.integers(1, 14))):
                    inner = ("h1",) if k == 0 and rng.random() < 0.8 else [("p",), ("p",), ("p",), ("p", "b"), ("h2",), ("ul", "li"), ("blockquote", "p"), ("p", "a"), ()][int(rng.integers(9))]
                    t = text("h1" in inner or "h2" in inner or rng.random() < 0.15)
                    blocks.append((body + container + inner, t, len(t) // 3 if "a" in inner else 0))
                    labels.append(1.0)
                    if rng.random() < 0.04:
                        place = BESIDE["advert"][int(rng.integers(len(BESIDE["advert"])))]
                        blocks.append((body + container + spelled(place), text(rng.random() < 0.5), 0))
                        labels.append(0.0)
            elif rng.random() < 0.6:
                for _ in range(int(rng.integers(1, 3)) if part not in ("menu", "comments") else 1):
                    path = spelled(BESIDE[part][int(rng.integers(len(BESIDE[part])))])
                    path = path if path[-1] == "p" else renamed(path, rng, 0, 0.05, 0.1)
                    for _ in range(int(rng.integers(1, 7)) if part in ("menu", "comments", "sidebar", "form") else 1):
                        t = text(part in ("menu", "form", "header") or rng.random() < 0.3)
                        blocks.append((body + path, t, len(t) if path[-1] == "a" else 0))
                        labels.append(0.0)
        pages.append(described(blocks))
        gold.append(np.array(labels))
    return pages, gold


def fit(pages: DataFrame, sample: int = SAMPLE) -> Labeller:
    """Train on at most `sample` pages, the first by a hash of their url, and on pages composed of their blocks."""
    of = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30))
    bound = min(1.0, 2 * sample / max(1, pages.count())) * (1 << 30)  # so that tasks send about twice the sample in all, however many they are
    rows = pages.where((F.length("html") > 0) & (of < bound)).select(of.alias("of"), F.substring("html", 1, SAMPLE_CHARS).alias("html")).orderBy("of", "html").limit(sample).collect()
    own, gold, texts, rng = [], [], ["main text of a page", "menu"], np.random.default_rng(1)
    for r in rows:
        blocks = blocks_of(r["html"])[:LEAVES]
        texts += [t for _, t, _ in blocks if len(t) > 3][:12]
        if blocks and (labels := marked(blocks)) is not None:
            for version in (blocks, without_marks(blocks, labels, rng)):
                own.append(described(version))
                gold.append(labels)
    more, more_gold = composed(texts, np.random.default_rng(0))
    model = Labeller()
    model.fit(own + more, gold + more_gold)
    return model


# ---------------------------------------------------------------- Spark


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [blocks_of(h, path_place) for h in part.column("html").to_pylist()]
                texts = [""] * len(found)
                order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
                at = 0
                while at < len(order):
                    # pages side by side, shortest first, as long as they hold few blocks in all
                    some = [order[at]]
                    while at + len(some) < len(order) and len(found[order[at + len(some)]]) * (len(some) + 1) <= 16_384:
                        some.append(order[at + len(some)])
                    at += len(some)
                    p, _ = model.scores([described(found[k]) for k in some])
                    for column, k in enumerate(some):
                        texts[k] = "\n".join(t for (_, t, _), main in zip(found[k], (p[:, column] >= 0.5).tolist(), strict=False) if main)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")
