"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its blocks, the stretches of text between block-level tags, each with
its tag path. A block's vector holds the tags of its path, hashed words of class, id and role on the
path, hashed words of its text and a few measures; a bidirectional LSTM in numpy reads the whole
sequence and labels every block as article or not. Scripts, styles, comments of the markup and what
a browser never shows as text are no blocks.

The labeller is trained by train() on n_train invented pages whose layouts, class names and words
vary at random. `python -m tidemark.llm.html_text` does so and stores the weights, well under a
megabyte, beside this file with a version that stands for the vectors they fit; labeller() reads
them, or trains anew where they are missing or of another version. They are broadcast. Nothing is
learned from the pages it labels.

Reading a page takes time in proportion to its length, whatever it holds: a '<' that begins no tag
is text, and a tag ends at its '>' or isn't one.

Defined cases: null or empty html gives an empty text; repeated rows are labelled one by one; broken
markup is read as far as it goes (an unclosed script, style, frame or comment lasts to the end); very
long pages are read whole, and their blocks go through the network stretch by stretch; elements
unknown to HTML are inline, those with a hyphen in their name blocks; an empty table gives no rows.
Other columns aren't returned.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, run_hashes, texts, word_spans

#: Element names of HTML that end or begin a block, stay inside one, or hold no shown text.
BLOCK_TAGS = "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
INLINE_TAGS = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var audio canvas math object svg video".split()
RAW_TAGS = "script style template noscript iframe textarea".split()
VOID_TAGS = "area base br col embed hr img input link meta source track wbr".split()
TAGS = {t: k for k, t in enumerate(BLOCK_TAGS + INLINE_TAGS)}
PATH_WORDS, TEXT_WORDS, MEASURES, HIDDEN = 128, 32, 6, 16
SIZE = len(TAGS) + PATH_WORDS + TEXT_WORDS + MEASURES

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+|[^<>]*+)>")
#: Where an element without markup inside ends.
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW_TAGS}
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b|display\s*:\s*(none)", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")


def named(rest: str) -> tuple[int, ...]:
    """Places among PATH_WORDS of the words, and beginnings of words, in class, id and role."""
    return _named_short(rest) if len(rest) < 300 else _named(rest)


def _named(rest: str) -> tuple[int, ...]:
    out = set()
    for groups in NAMED.findall(rest):
        for word in PART.findall("".join(groups)):
            word = word.lower()
            if len(word) > 1:
                out |= {zlib.crc32(w.encode()) % PATH_WORDS for w in (word, word.rstrip("s"), word[:4] + "~" if len(word) > 4 else word.rstrip("s"))}
    return tuple(sorted(out))


_named_short = functools.lru_cache(50_000)(_named)
BlockPath = tuple[frozenset, frozenset, int, int]


def blocks(page: str) -> tuple[list[str], list[BlockPath]]:
    """Text of each block; tags and attribute words on its path, its depth and characters inside links."""
    # each open element with the tags and words of the whole path down to it
    stack: list[tuple[str, frozenset, frozenset]] = []
    is_open: Counter = Counter()
    out, paths, text, linked, path = [], [], [], 0, None

    def end() -> None:
        nonlocal text, linked, path
        if text:
            joined = SPACES.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(joined)
                paths.append((*path, linked))
        text, linked, path = [], 0, None

    def add(piece: str) -> None:
        nonlocal linked, path
        if path is None and not piece.isspace():
            path = (*(stack[-1][1:] if stack else (frozenset(), frozenset())), len(stack))
        if path is not None:
            text.append(piece)
            if is_open["a"]:
                linked += len(piece)

    def push(name: str, words: tuple[int, ...]) -> None:
        tags, held = stack[-1][1:] if stack else (frozenset(), frozenset())
        stack.append((name, tags if name in tags or name not in TAGS else tags | {name}, held if held.issuperset(words) else held.union(words)))
        is_open[name] += 1

    def pop(to: int) -> None:
        while len(stack) > to:
            is_open[stack.pop()[0]] -= 1

    at, last, endless = 0, page.rfind(">"), set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2)
            if start > at:
                add(page[at:start])
            at = stop + 3 if stop >= 0 else len(page)
            continue
        m = TAG.match(page, start) if start < last else None
        if m is None and page[start + 1 : start + 2] in ("!", "?") and start < last:
            if start > at:
                add(page[at:start])
            at = page.find(">", start) + 1
            continue
        if m is None:
            add(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        at = m.end()
        name, rest = m[2].lower(), m[3]
        inline = TAGS[name] >= len(BLOCK_TAGS) if name in TAGS else "-" not in name and name not in VOID_TAGS and name not in RAW_TAGS
        if not inline:
            end()
        if m[1]:
            if is_open[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name in RAW_TAGS:
            close = None if name in endless else RAW_END[name].search(page, at)
            if close:
                stop = page.find(">", close.end())
                at = stop + 1 if stop >= 0 else len(page)
            elif name in ("template", "noscript"):
                endless.add(name)  # nothing closes it: only the tag goes
            else:
                at = len(page)
            continue
        if name in VOID_TAGS or rest.endswith("/") and (name not in TAGS or name in ("svg", "math")):
            continue
        if not inline and name not in ("button", "label", "option", "select"):
            for k in range(len(stack) - 1, max(len(stack) - 5, -1), -1):
                if stack[k][0] == "p":
                    pop(k)  # a block ends an open paragraph
                    break
                if TAGS.get(stack[k][0], 0) < len(BLOCK_TAGS):
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            pop(len(stack) - 1)
        push(name, named(rest) if "=" in rest or "hidden" in rest else ())
    if at < len(page):
        add(page[at:])
    end()
    return out, paths


def vectors(pages: list[tuple[list[str], list[BlockPath]]]) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each block of all pages, and the number of blocks before each page."""
    every = [t for ts, _ in pages for t in ts]
    paths = [p for _, ps in pages for p in ps]
    out = np.zeros((len(every), SIZE), np.float32)
    at = np.concatenate([[0], np.cumsum([len(ts) for ts, _ in pages])]).astype(np.int64)
    if not every:
        return out, at
    places = [(k, TAGS[t]) for k, (tags, *_) in enumerate(paths) for t in tags] + [(k, len(TAGS) + w) for k, (_, ws, *_) in enumerate(paths) for w in ws]
    if places:
        rows, columns = np.array(places).T
        out[rows, columns] = 1
    run, offsets = texts(pa.array(every, pa.large_string()))
    starts, ends, first = word_spans(run, offsets)
    n = np.diff(first)
    bucket = (run_hashes(LOWER[run], starts, ends - starts) % np.uint64(TEXT_WORDS)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(every)), n) * TEXT_WORDS + bucket, minlength=len(every) * TEXT_WORDS).reshape(-1, TEXT_WORDS)
    base = len(TAGS) + PATH_WORDS
    out[:, base : base + TEXT_WORDS] = counts / np.maximum(np.sqrt((counts * counts).sum(1)), 1)[:, None] * 0.3
    size = np.diff(offsets)
    marks = np.bincount(np.searchsorted(offsets, np.flatnonzero(np.isin(run, list(b".,;:!?"))), "right") - 1, minlength=len(every))
    links = np.array([p[3] for p in paths]) / np.maximum(size, 1)
    depth = np.minimum([p[2] for p in paths], 40)
    place = np.arange(len(every)) - np.repeat(at[:-1], np.diff(at))
    out[:, base + TEXT_WORDS :] = np.stack([np.minimum(np.log1p(n) / 4, 1.2), np.minimum(links, 1), np.minimum(marks / np.maximum(n, 1), 0.3), depth / 8, place / np.repeat(np.maximum(np.diff(at), 1), np.diff(at)), n < 4], 1)
    return out, at


#: Blocks, padding included, whose vectors are held at once.
CELLS = 1 << 16


class Labeller:
    """A bidirectional LSTM with one logit a block; weights in w."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        one = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"out_x": one(SIZE) * 0, "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.w |= {f"x{d}": one(SIZE, 4 * HIDDEN), f"h{d}": one(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32), ("out_f" if d == "f" else "out_b2"): one(HIDDEN)}
            self.w[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1

    def _step(self, z: np.ndarray, h: np.ndarray, c: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        return m * o * tc + (1 - m) * h, m * c_new + (1 - m) * c, (h, c, i, f, o, g, tc, m)

    def _one_way(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        inputs, hs, kept = x @ self.w[f"x{d}"] + self.w[f"b{d}"], [], []
        for t in range(len(x)):
            h, c, state = self._step(inputs[t] + h @ self.w[f"h{d}"], h, c, mask[t][:, None])
            kept.append(state)
            hs.append(h)
        return np.stack(hs), kept

    def _scores(self, x: np.ndarray, mask: np.ndarray, d: str, out: str, stretch: int) -> np.ndarray:
        """One direction's part of the logits. Keeps no states and multiplies inputs by stretches of steps."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        scores = np.zeros(x.shape[:2], np.float32)
        for k in range(0, len(x), stretch):
            inputs = x[k : k + stretch] @ self.w[f"x{d}"] + self.w[f"b{d}"]
            for t in range(len(inputs)):
                h, c, _ = self._step(inputs[t] + h @ self.w[f"h{d}"], h, c, mask[k + t][:, None])
                scores[k + t] = h @ self.w[out]
        return scores

    def logits(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: step, page, vector; mask: step, page."""
        hf, kf = self._one_way(x, mask, "f")
        hb, kb = self._one_way(x[::-1], mask[::-1], "b")
        return hf @ self.w["out_f"] + hb[::-1] @ self.w["out_b2"] + x @ self.w["out_x"] + self.w["out_b"], (hf, kf, hb, kb)

    def gradients(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        z, (hf, kf, hb, kb) = self.logits(x, mask)
        p = 1 / (1 + np.exp(-z))
        dz = ((p - truth) * mask / mask.sum()).astype(np.float32)
        g = {"out_x": np.einsum("tb,tbd->d", dz, x), "out_b": dz.sum().reshape(1), "out_f": np.einsum("tb,tbh->h", dz, hf), "out_b2": np.einsum("tb,tbh->h", dz[::-1], hb)}
        for d, kept, out, dd, xx in (("f", kf, "out_f", dz, x), ("b", kb, "out_b2", dz[::-1], x[::-1])):
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            dzs, gh = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(self.w[f"h{d}"])
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, gg, tc, m = kept[t]
                dh = dh + dd[t][:, None] * self.w[out]
                a = m * dh
                dct = m * dc + a * o * (1 - tc * tc)
                da = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), a * tc * o * (1 - o), dct * i * (1 - gg * gg)], 1)
                dzs[t] = da
                gh += h.T @ da
                dh = (1 - m) * dh + da @ self.w[f"h{d}"].T
                dc = (1 - m) * dc + dct * f
            g |= {f"h{d}": gh, f"x{d}": np.einsum("tbd,tbk->dk", xx, dzs, optimize=True), f"b{d}": dzs.sum((0, 1))}
        loss = -float((mask * (truth * np.log(p + 1e-7) + (1 - truth) * np.log(1 - p + 1e-7))).sum() / mask.sum())
        return loss, g

    def labels(self, x: np.ndarray, at: np.ndarray, batch: int = 256, cells: int = CELLS) -> np.ndarray:
        """Which blocks are article, for the vectors of vectors(). Pages run together while longest x pages is within cells."""
        n, out = np.diff(at), np.zeros(len(x), bool)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        k = 0
        while k < len(order):
            sizes = n[order[k : k + batch]]
            mine = order[k : k + max(1, int((sizes * np.arange(1, len(sizes) + 1) <= cells).sum()))]
            k += len(mine)
            longest = int(n[mine].max())
            step = np.concatenate([np.arange(c) for c in n[mine]])
            page, flat = np.repeat(np.arange(len(mine)), n[mine]), np.concatenate([np.arange(at[i], at[i + 1]) for i in mine])
            mask = np.zeros((longest, len(mine)), np.float32)
            mask[step, page] = 1
            if len(mine) == 1:
                wide = x[at[mine[0]] : at[mine[0] + 1], None]
            else:
                wide = np.zeros((longest, len(mine), SIZE), np.float32)
                wide[step, page] = x[flat]
            stretch = max(1, cells // 8 // len(mine))
            z = self._scores(wide, mask, "f", "out_f", stretch) + self._scores(wide[::-1], mask[::-1], "b", "out_b2", stretch)[::-1]
            out[flat] = (z + wide @ self.w["out_x"] + self.w["out_b"])[step, page] > 0
        return out


#: For invented pages: element, class names and whether it is article. {} takes blocks.
SHELLS = ("<article{}>", "<main{}>", "<section{}>", "<div{}>")
ARTICLE_NAMES = ("", "", "content", "post", "entry", "article-body", "main", "story", "text", "post-content", "page")
NOT_ARTICLE = (
    ("nav", ("", "menu", "navbar", "main-nav", "breadcrumbs", "navigation"), "links"), ("ul", ("menu", "nav", "links", "tabs", "breadcrumb"), "links"), ("div", ("menu", "nav", "navigation", "topbar", "toolbar", "pagination", "pager", "breadcrumbs"), "links"),
    ("header", ("", "header", "site-header", "masthead", "top"), "mix"), ("div", ("header", "masthead", "site-header", "logo", "site-title"), "mix"),
    ("footer", ("", "footer", "site-footer", "bottom"), "mix"), ("div", ("footer", "copyright", "legal", "colophon"), "mix"),
    ("aside", ("", "sidebar", "widget", "related", "rail"), "mix"), ("div", ("sidebar", "side", "widget", "related", "recommended", "trending", "popular", "rail", "more"), "mix"),
    ("div", ("cookie", "cookies", "notice", "banner", "alert", "consent", "gdpr", "newsletter", "subscribe", "popup", "modal", "message", "warning", "disclaimer", "paywall"), "prose"), ("section", ("notice", "banner", "newsletter", "cookie-bar"), "prose"), ("dialog", ("", "modal"), "prose"),
    ("div", ("ad", "ads", "advert", "advertisement", "adbox", "sponsor", "sponsored", "promo", "promotion", "commercial"), "prose"), ("ins", ("adsbygoogle", "ad"), "prose"), ("aside", ("ad", "advert", "promo"), "prose"),
    ("form", ("", "search", "login", "signup", "contact"), "form"), ("div", ("search", "login", "signup", "share", "social", "tags", "meta-links"), "form"),
    ("section", ("comments", "comment-list", "responses", "discussion"), "comments"), ("div", ("comments", "comment", "replies", "reply", "disqus", "feedback", "reviews"), "comments"), ("ol", ("comments", "commentlist", "comment-list"), "comments"), ("ul", ("comments", "comment-list"), "comments"),
)
SMALL_WORDS = "home about contact login sign up search menu share tweet subscribe cookies accept privacy terms copyright rights reserved advertisement sponsored comments reply posted related more next previous email name submit".split()


def invented(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page at random, and the words that only its article has."""
    letters = ("aeiou", "bcdfglmnprst", "äöüßéèçñíóabcdeghilmnoprstu")
    n_words, own = 0, set()

    def word() -> str:
        kind = letters[2] if rng.random() < 0.3 else None
        return "".join(letters[k % 2][rng.integers(len(letters[k % 2]))] if kind is None else kind[rng.integers(len(kind))] for k in range(int(rng.integers(2, 9))))

    def prose(n: int, article: bool) -> str:
        nonlocal n_words
        words = []
        for _ in range(n):
            n_words += 1
            words.append(f"{word()}" if article or rng.random() > 0.15 else SMALL_WORDS[rng.integers(len(SMALL_WORDS))])
            if rng.random() < 0.12:
                words[-1] += ".,"[rng.integers(2)]
        tag = f"{'w' if article else 'z'}q{n_words}x"
        if article:
            own.add(tag)
        words[rng.integers(len(words))] = tag
        if rng.random() < 0.1:
            k = rng.integers(len(words))
            inline = ("b", "em", "span", "a href=#", "i", "strong")[rng.integers(6)]
            words[k] = f"<{inline}>{words[k]}" + (f"</{inline.split()[0]}>" if rng.random() < 0.9 else "")
        return " ".join(words)

    def names(options: tuple[str, ...]) -> str:
        name = options[rng.integers(len(options))]
        noise = f"{word()}{rng.integers(99)}" if rng.random() < 0.2 else ""
        value = " ".join(x for x in (name, noise) if x)
        return f' {("class", "class", "id")[rng.integers(3)]}="{value}"' if value else ""

    def few(most: int = 12) -> int:
        return int(rng.integers(1, most))

    def outside(depth: int = 0) -> str:
        tag, options, kind = NOT_ARTICLE[rng.integers(len(NOT_ARTICLE))]
        links = lambda: "".join(f'<li><a href="/x">{prose(few(5), False)}</a></li>' for _ in range(few(8)))
        if kind == "links":
            inner = links() if tag == "ul" else f"<ul>{links()}</ul>" if rng.random() < 0.6 else "".join(f'<a href="#">{prose(few(4), False)}</a> ' for _ in range(few(6)))
        elif kind == "form":
            inner = f"<label>{prose(few(5), False)}</label><input name=q><select><option>{prose(1, False)}</option><option>{prose(1, False)}</option></select><button>{prose(few(3), False)}</button><p>{prose(few(), False)}</p>"
        elif kind == "comments":
            item = "li" if tag in ("ol", "ul") else "div"
            inner = (f"<h3>{prose(few(5), False)}</h3>" if tag not in ("ol", "ul") else "") + "".join(f"<{item}><b>{prose(2, False)}</b><p>{prose(few(60), False)}</p></{item}>" for _ in range(few(6)))
        elif kind == "prose" or rng.random() < 0.6:
            inner = prose(few(50), False) if rng.random() < 0.5 else "".join(f"<p>{prose(few(50), False)}</p>" for _ in range(few(4)))
        else:
            inner = f"<h3>{prose(few(6), False)}</h3><ul>{links()}</ul>"
        if kind == "mix" and depth == 0 and rng.random() < 0.2:
            inner += outside(1)
        return f"<{tag}{names(options)}>{inner}</{tag}>"

    def article() -> str:
        heading = lambda low, high, n: f"<h{(k := rng.integers(low, high))}>{prose(few(n), True)}</h{k}>"
        parts = [heading(1, 3, 14)] if rng.random() < 0.85 else []
        for _ in range(few(14) if rng.random() < 0.85 else few(60)):
            kind = rng.random()
            if kind < 0.7 and rng.random() < 0.08:  # the same words, or the same paragraph, again and again
                again = prose(few(4), True)
                parts += [f"<p>{again}</p>"] * few(9) if rng.random() < 0.5 else [f"<p>{' '.join([again] * few(40))}</p>"]
                continue
            if kind < 0.7:
                parts.append(f"<p>{prose(int(rng.integers(1, 90)), True)}" + ("<br>" + prose(few(), True) if rng.random() < 0.1 else "") + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.8:
                parts.append(heading(2, 5, 9))
            elif kind < 0.88:
                parts.append("<ul>" + "".join(f"<li>{prose(few(20), True)}</li>" for _ in range(few(6))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{prose(few(40), True)}</p></blockquote>")
            elif kind < 0.95:
                parts.append("<table>" + "".join(f"<tr><td>{prose(few(6), True)}</td><td>{prose(few(6), True)}</td></tr>" for _ in range(few(4))) + "</table>")
            elif kind < 0.97:
                parts.append(f"<pre>{prose(few(20), True)}</pre>")
            else:
                parts.append(outside())
        shell = SHELLS[int(rng.integers(4))] if rng.random() < 0.9 else "<div{}>"
        tag = re.match(r"<(\w+)", shell)[1]
        inner = shell.format(names(ARTICLE_NAMES)) + "".join(parts) + f"</{tag}>"
        return f"<main>{inner}</main>" if tag != "main" and rng.random() < 0.2 else inner

    before, after = ("".join(outside() for _ in range(int(rng.integers(0, 5)))) for _ in range(2))
    head = f"<head><title>{prose(few(12), False)}</title></head>"
    body = before + article() + after
    wrapped = f"<div{names(('wrapper', 'container', 'page', ''))}>{body}</div>" if rng.random() < 0.4 else body
    return f"<html>{head}<body>{wrapped}</body></html>", own


@functools.lru_cache(2)
def train(n_train: int = 700, epochs: int = 20, seed: int = 3, rate: float = 0.01) -> Labeller:
    """A labeller fitted to n_train invented pages; the same for the same arguments."""
    rng = np.random.default_rng(seed)
    made = [invented(rng) for _ in range(n_train)]
    cut = [blocks(page) for page, _ in made]
    truth = np.array([any(w.rstrip(".,") in own for w in text.split()) for (_, own), (found, _) in zip(made, cut) for text in found], np.float32)
    x, at = vectors(cut)
    model = Labeller(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.w.items()} for _ in range(2))
    order, step = np.argsort(np.diff(at), kind="stable"), 0
    groups = [order[k : k + 32] for k in range(0, n_train, 32)]
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            mine = groups[k]
            longest = int(np.diff(at)[mine].max())
            wide, mask, want = np.zeros((longest, len(mine), SIZE), np.float32), np.zeros((longest, len(mine)), np.float32), np.zeros((longest, len(mine)), np.float32)
            for j, page in enumerate(mine):
                a, b = at[page], at[page + 1]
                wide[: b - a, j], mask[: b - a, j], want[: b - a, j] = x[a:b], 1, truth[a:b]
            wide *= rng.random(wide.shape) > 0.05  # so that no single mark decides,
            wide[:, rng.random(len(mine)) < 0.4, len(TAGS) + PATH_WORDS :] = 0  # nor odd wording
            _, grad = model.gradients(wide, mask, want)
            step += 1
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                model.w[name] = (model.w[name] - rate * (1 - epoch / epochs) * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


STORED = Path(__file__).with_name("html_labeller.npz")
#: Changes whenever a block's vector means something else, or the network has another shape.
VERSION = zlib.crc32(repr((1, TAGS, PATH_WORDS, TEXT_WORDS, MEASURES, HIDDEN)).encode())


@functools.lru_cache(1)
def labeller() -> Labeller:
    """The stored labeller, or one trained now."""
    if STORED.exists():
        with np.load(STORED) as held:
            if int(held["version"]) == VERSION:
                model = Labeller()
                model.w = {k: held[k] for k in model.w}
                return model
    return train()


def store(n_train: int = 6000) -> None:
    np.savez_compressed(STORED, version=VERSION, **train(n_train).w)


def extracted(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", model: Labeller | None = None) -> DataFrame:
    """id, text, n_chars and n_blocks (of the page, article or not) of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or labeller())
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 512):
                batch = whole.slice(k, 512)
                cut = [blocks(page or "") for page in batch.column("_html").to_pylist()]
                n = np.array([len(found) for found, _ in cut])
                out = []
                for part in np.split(np.arange(len(cut)), np.flatnonzero(np.diff(np.cumsum(n) // CELLS)) + 1):
                    mine = cut[part[0] : part[-1] + 1]
                    x, at = vectors(mine)
                    keep = sent.value.labels(x, at)
                    out += [" ".join(t for t, y in zip(found, keep[a:b]) if y) for (found, _), a, b in zip(mine, at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(n, pa.int64())], names=["_id", "text", "n_chars", "n_blocks"])

    return pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html")).mapInArrow(run, f"_id {kind}, text string, n_chars long, n_blocks long").withColumnRenamed("_id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("n_blocks")


if __name__ == "__main__":
    store()
