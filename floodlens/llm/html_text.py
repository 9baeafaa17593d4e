"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A block is main text or not; its features are the tags around it, the words in their class, id and role, and properties of
its text; neighbouring labels are tied. Weights are trained on labelled pages (:func:`labelled_pages`, drawn by rule from
layouts that sites use) by maximum likelihood, and pages are decoded by Viterbi.

Defined results: a null or empty page has empty text; so has a page on which no block is main text. Every block that is
decoded as main text is kept whole; nothing is capped.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from floodlens.llm.common import in_arrow
from floodlens.llm.html_blocks import Block, blocks

SEPARATOR = "\n\n"
#: Labelled pages trained on, passes over them, and the strength that keeps weights small.
PAGES, PASSES, SHRINK = 1500, 200, 3e-4
_ENDS = re.compile(r"[.!?…。][\"'”’»)]*$")


def features(page: Sequence[Block]) -> list[list[str]]:
    """Names of the features that hold, block by block."""
    out = []
    for i, b in enumerate(page):
        words = b.text.split()
        own = b.path[-1] if b.path else "none"
        links = min(1.0, b.link_chars / max(1, len(b.text)))
        f = ["bias", f"own={own}", f"words={min(7, len(words).bit_length())}", f"links={int(links * 4)}"]
        f += [f"in={t}" for t in set(b.path)] + [f"named={n}" for n in b.names] + [f"near={n}" for n in b.near]
        f += ["end"] if _ENDS.search(b.text) else []
        f += ["copyright"] if "©" in b.text else []
        f += ["bare"] if not set(b.path) - {"html", "body"} else []
        f += ["first"] if i == 0 else []
        f += ["last"] if i == len(page) - 1 else []
        f += ["many_commas"] if b.text.count(",") > 2 else []
        out.append(f)
    return out


@dataclass
class ChainModel:
    """Weights of the features (for main text against other text) and of label pairs and first labels."""

    weights: dict[str, float]
    pairs: np.ndarray  # pairs[a, b]: label a before label b
    first: np.ndarray

    def decode(self, page: Sequence[Block]) -> list[bool]:
        """The likeliest labels of a page, by Viterbi; ties go to other text."""
        if not page:
            return []
        get = self.weights.get
        emit = [sum(get(f, 0.0) for f in fs) for fs in features(page)]
        (p00, p01), (p10, p11) = self.pairs.tolist()
        s0, s1 = float(self.first[0]), float(self.first[1]) + emit[0]
        back = []
        for e in emit[1:]:
            from0, from1 = s1 + p10 > s0 + p00, s1 + p11 >= s0 + p01
            back.append((from0, from1))
            s0, s1 = (s1 + p10 if from0 else s0 + p00), (s1 + p11 if from1 else s0 + p01) + e
        labels = [s1 > s0]
        for choice in reversed(back):
            labels.append(bool(choice[labels[-1]]))
        return labels[::-1]

    def main_text(self, page: str | None) -> str:
        found = list(blocks(page))
        return SEPARATOR.join(b.text for b, main in zip(found, self.decode(found)) if main)


def train(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]], passes: int = PASSES, shrink: float = SHRINK) -> ChainModel:
    """Maximum-likelihood weights from blocks and their labels, by Adam on the exact gradient (forward and backward sums)."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, columns = [], []
    longest = max((len(b) for b, _ in pages), default=1)
    for i, (b, _) in enumerate(pages):
        for t, fs in enumerate(features(b)):
            rows += [i * longest + t] * len(fs)
            columns += [names.setdefault(f, len(names)) for f in fs]
    rows, columns = np.array(rows), np.array(columns)
    n, d = len(pages), len(names)
    mask = np.array([[t < len(b) for t in range(longest)] for b, _ in pages])
    gold = np.array([[t < len(y) and bool(y[t]) for t in range(longest)] for _, y in pages])
    theta = np.zeros(d + 6)
    step, square = np.zeros_like(theta), np.zeros_like(theta)
    both = mask[:, 1:]
    gold_pairs = np.array([[(both & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    gold_first = np.array([(~gold[:, 0]).sum(), gold[:, 0].sum()])
    for k in range(1, passes + 1):
        w, pairs, first = theta[:d], theta[d:d + 4].reshape(2, 2), theta[d + 4:]
        emit = np.bincount(rows, weights=w[columns], minlength=n * longest).reshape(n, longest)
        score = np.stack([np.zeros_like(emit), emit], axis=2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = first + score[:, 0]
        for t in range(1, longest):
            moved = np.logaddexp(forward[:, t - 1, 0, None] + pairs[0], forward[:, t - 1, 1, None] + pairs[1]) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            after = score[:, t + 1] + backward[:, t + 1]
            moved = np.logaddexp(pairs[:, 0] + after[:, 0, None], pairs[:, 1] + after[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], moved, backward[:, t + 1])
        belief = np.exp(forward + backward - total[:, None, None])[:, :, 1] * mask
        joint = np.exp(forward[:, :-1, :, None] + pairs + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        error = (gold - belief) * mask
        gradient = np.concatenate([
            np.bincount(columns, weights=error.reshape(-1)[rows], minlength=d), (gold_pairs - joint.sum(axis=(0, 1))).reshape(-1),
            gold_first - np.stack([1 - belief[:, 0], belief[:, 0]]).sum(axis=1)]) / n - shrink * theta
        step, square = 0.9 * step + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.1 * (step / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return ChainModel({f: float(theta[i]) for f, i in names.items()}, theta[d:d + 4].reshape(2, 2), theta[d + 4:])


# Names that sites give to their main text and to what surrounds it.
MAIN_NAMES = "content article post entry story text body main page single blog news".split()
NEUTRAL = "container wrapper row col column inner page site layout grid block section".split()
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toc pagination pager".split(),
    "header": "header masthead logo branding banner hero tagline".split(),
    "footer": "footer bottom colophon copyright legal credits contentinfo".split(),
    "aside": "sidebar side aside widget related recommended trending popular more rail complementary".split(),
    "div": "ad ads advert advertisement sponsor sponsored promo promoted cookie consent notice alert gdpr popup modal overlay newsletter subscribe signup "
           "share social sharing tags meta byline author login search".split(),
    "section": "comments comment replies reply responses response discussion respond disqus feedback reactions".split(),
    "form": "form login search subscribe contact newsletter".split(),
}


class _Layout:
    """One labelled page: markup and, block by block, whether it is main text."""

    def __init__(self, rng: random.Random) -> None:
        self.rng, self.out, self.labels = rng, [], []
        letters = "aeiourstnldmk"
        self.words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def some(self, least: int, most: int, end: str = "") -> str:
        rng = self.rng
        words = [rng.choice(self.words) + ("," if rng.random() < 0.06 else "." if rng.random() < 0.06 else "") for _ in range(rng.randint(least, most))]
        return (" ".join(words).capitalize() + end).replace(" a ", " &amp; ")

    def put(self, tag: str, text: str, main: bool, attributes: str = "", close: bool = True) -> None:
        self.out.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if close else ""))
        self.labels.append(main)

    def prose(self) -> None:
        rng = self.rng
        tag = rng.choices(["p", "li", "blockquote", "h2", "h3", "pre", "td", "div"], [30, 2, 1, 2, 1, 1, 1, 1])[0]
        text = self.some(1, 12) if tag in ("h2", "h3") else self.some(*rng.choice([(1, 4), (3, 20), (20, 80), (60, 160)]), rng.choice([".", ".", ""]))
        if rng.random() < 0.15:
            text = f"<b>{text}" + rng.choice(["</b>", "<br>"])
        if rng.random() < 0.15:
            text = text.replace(" ", f' <a href="/x">{rng.choice(self.words)}</a> ', 1)
        elif rng.random() < 0.05:
            text = f'<a href="/x">{text}</a>'
        self.put(tag, text, True, close=rng.random() < 0.9 or tag != "p")

    def links(self, tag: str, names: list[str]) -> None:
        rng = self.rng
        attribute = rng.choice(["class", "id"])
        self.out.append(f"<{tag}" + (f' {attribute}="{rng.choice(names)}"' if tag == "div" or rng.random() < 0.6 else "") + "><ul>")
        for _ in range(rng.randint(2, 7)):
            self.put("li", f'<a href="/{rng.choice(self.words)}">{self.some(1, 4)}</a>', False)
        self.out.append(f"</ul></{tag}>")

    def apart(self, kind: str) -> None:
        rng, names = self.rng, OTHER[kind]
        tag = rng.choice([kind, "div"]) if kind not in ("nav", "footer") else rng.choice([kind, kind, "div"])
        if kind in ("nav", "aside") and rng.random() < 0.7:
            self.links(tag, names)
            return
        name = rng.choice(names) + rng.choice(["", "", "-box", "_1", "-wrapper", f" {rng.choice(NEUTRAL)}"])
        text = self.some(*rng.choice([(1, 6), (5, 30), (20, 70)]), rng.choice([".", ".", ""]))
        if rng.random() < 0.35:
            self.put(rng.choice(["p", "p", "div"]), text, False, f' {rng.choice(["class", "id"])}="{name}"')
            return
        if kind == "footer":
            text = rng.choice(["&copy; ", "", ""]) + text
        inner = rng.choice(["", "p", "p", "span", "h3"]) if kind != "header" else rng.choice(["", "h1", "p", "span"])
        named = tag in ("div", "section") or rng.random() < 0.5
        self.out.append(f"<{tag}" + (f' {rng.choice(["class", "id"])}="{name}"' if named else "") + ">")
        for _ in range(rng.choice([1, 1, 1, 2, 4]) if inner and inner != "span" else 1):
            if inner and inner != "span":
                self.put(inner, text, False)
            else:
                self.out.append(f"<{inner}>{text}</{inner}>" if inner else text)
                self.labels.append(False)
        self.out.append(f"</{tag}>")

    def comments(self) -> None:
        """A list of what readers wrote, with their names and dates."""
        rng = self.rng
        tag, item = rng.choice([("ol", "li"), ("ul", "li"), ("div", "div"), ("section", "article")])
        name = rng.choice(["commentlist", "comment-list", "comments", "commentsArea", "comment-thread", "replies", "discussion_thread"])
        self.out.append(f"<{tag} {rng.choice(['class', 'id'])}={name}>" if rng.random() < 0.3 else f'<{tag} class="{name}">')
        for _ in range(rng.randint(1, 5)):
            self.out.append(f"<{item}" + rng.choice(["", ' class="comment"', f' class="comment depth-{rng.randint(1, 4)}"', " id=reply-1"]) + ">")
            if rng.random() < 0.6:
                self.put(rng.choice(["cite", "span", "p", "h4", "div"]), self.some(1, 3), False)
                if self.out[-1].startswith(("<cite", "<span")):  # runs on into the text
                    self.labels.pop()
            self.put(rng.choice(["p", "p", "div"]) if rng.random() < 0.8 or self.out[-1].startswith(("<cite", "<span")) else "p", self.some(3, 60, rng.choice([".", "!", ""])), False)
            if self.out[-2].startswith(("<cite", "<span")):
                self.labels.append(False)
            self.out.append(f"</{item}>" if item != "li" or rng.random() < 0.7 else "")
        self.out.append(f"</{tag}>")

    def build(self) -> str:
        rng = self.rng
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' + self.some(2, 9) + '</title><style>p{}</style><script>var t="</p>";</script>')
        self.out.append(rng.choices(["</head><body>", "<body>", "</head>", ""], [7, 1, 1, 1])[0])
        if rng.random() < 0.05:
            self.out.append(rng.choice(["<object data=x>", "<p title=it's>", "<svg>", '<select name="a">']))
        for kind in rng.sample(["nav", "header", "div", "div", "form"], rng.randint(0, 3)):
            self.apart(kind)
        around = [f'<div class="{rng.choice(NEUTRAL)}{rng.choice(["", "-fluid", " main"])}">' for _ in range(rng.choice([0, 0, 0, 1, 2]))]
        self.out += around
        holder = rng.choices(["article", "main", "named", "nested", "bare"], [5, 2, 4, 3, 1])[0]
        name = rng.choice(MAIN_NAMES) + rng.choice(["", "", "-content", "_body", "-text"])
        opened = {"article": "<article>", "main": "<main>", "named": f'<div class="{name}">', "nested": f'<main><article class="{name}">', "bare": ""}[holder]
        closed = {"article": "</article>", "main": "</main>", "named": "</div>", "nested": "</article></main>", "bare": ""}[holder]
        self.out.append(opened)
        if rng.random() < 0.8:
            inside = opened and rng.random() < 0.15
            self.out.append("<header>" if inside else "")
            self.put("h1", self.some(1, 12), True)
            self.out.append("</header>" if inside else "")
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            self.prose()
            if rng.random() < 0.15:
                self.apart(rng.choice(["div", "div", "div", "aside", "section", "form"]))
        if rng.random() < 0.3:
            self.apart(rng.choice(["div", "aside", "section", "footer"]))
        if rng.random() < 0.15:
            self.comments()
        if rng.random() < 0.9:
            self.out.append(closed)
        if rng.random() < 0.1:
            self.put("p", f"&copy; {self.some(1, 8)}", False)
        if rng.random() < 0.15:
            self.comments()
        if around and rng.random() < 0.7:
            self.apart(rng.choice(["aside", "div", "section"]))
        self.out += ["</div>"] * len(around)
        if rng.random() < 0.8:
            for kind in rng.sample(["section", "aside", "div", "footer", "form", "nav"], rng.randint(0, 4)):
                self.apart(kind)
            self.apart("footer")
        self.out.append(rng.choice(["</body></html>", ""]))
        return "".join(self.out)


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[bool]]]:
    """``n`` pages with the label of each of their blocks; the same for the same seed."""
    out = []
    for i in range(n):
        layout = _Layout(random.Random(f"{seed}:{i}"))
        out.append((layout.build(), layout.labels))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> ChainModel:
    """The model trained on the labelled pages; pages whose parse finds other blocks than were put in are set aside."""
    parsed = [(list(blocks(page)), labels) for page, labels in labelled_pages(PAGES)]
    return train([(found, labels) for found, labels in parsed if len(found) == len(labels)])


def main_text(pages: DataFrame, model: ChainModel | None = None, html_col: str = "html") -> DataFrame:
    """The rows of ``pages`` without their html, with ``text`` and ``n_chars`` (its code points) added."""
    model = model or trained()
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, html_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.main_text(p) for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"])

    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")
    return in_arrow(rows, compute, schema)
