"""Text functions: words, stems, times, chunks, differences, HTML and JSON."""

from __future__ import annotations

import difflib
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that carry no topic (fixed values).
STOP_WORDS = (
    "a", "about", "all", "also", "although", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "did", "each", "every", "for", "from", "had", "have", "he", "her", "him", "his", "how",
    "i", "if", "in", "is", "it", "its", "my", "nbsp", "next", "no", "not", "of", "on", "one", "or", "our", "out", "quite", "really", "so", "some", "that", "the", "them", "then", "there", "this", "to", "too",
    "use", "very", "was", "we", "what", "when", "where", "who", "will", "with", "you",
)


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1))


# ---- Porter's algorithm, from its published description ---------------------------------------------

_VOWEL = set("aeiou")


def _cons(w: str, i: int) -> bool:
    c = w[i]
    return c not in _VOWEL and (c != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    s = "".join("c" if _cons(w, i) else "v" for i in range(len(w)))
    return len(re.findall("vc", re.sub(r"(.)\1+", r"\1", s)))


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 1) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 3) and w[-1] not in "wxy"


#: Suffix pairs of steps 2 and 3 and the suffixes of step 4 of the published algorithm (fixed values).
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(w: str, table) -> str:
    for suffix, to in sorted(table, key=lambda p: -len(p[0])):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            return head + to if _measure(head) > 0 else w
    return w


def porter(word: str) -> str:
    """The stem of a lower-cased word; words of one or two letters stay."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            head = w[: -len(suffix)]
            if _measure(head) > 1 and (suffix != "ion" or head[-1:] in ("s", "t")):
                w = head
            break
    if w.endswith("e"):
        head = w[:-1]
        if _measure(head) > 1 or _measure(head) == 1 and not _cvc(head):
            w = head
    if _measure(w) > 1 and _double(w) and w[-1] == "l":
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(s: pd.Series) -> pd.Series:
    """Stems of a column of words; apply it to distinct words."""
    known: dict[str, str] = {}
    return s.map(lambda w: None if w is None else known[w] if w in known else known.setdefault(w, porter(w)))


# ---- time -------------------------------------------------------------------------------------------


def seconds_of(text: Column, fmt: str) -> Column:
    """Seconds since 1970 of a time text; format letters y Y M d D h H m s S, repeated for width. Null if it does not fit."""
    to = {"Y": "y", "D": "d", "h": "H", "S": "s"}
    return F.try_to_timestamp(text, F.lit("".join(to.get(c, c) for c in fmt))).cast("double")


def time_text(seconds: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(seconds.cast("timestamp"), fmt)


# ---- chunks and differences -------------------------------------------------------------------------


def chop(text: str, least: int, most: int) -> list[str]:
    """Chunks of ``least`` to ``most`` characters, cut after the last blank in that range, else at ``most``."""
    out, at = [], 0
    while len(text) - at > most:
        cut = text.rfind(" ", at + least - 1, at + most)
        cut = at + most if cut < at + least - 1 or cut < 0 else cut + 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]] if at < len(text) else out


def chopped(text: Column, least: int, most: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else chop(t, least, most))

    return run(text)


def differences(a: str, b: str, least: int = 1) -> list[tuple[str, str]]:
    """('=', both), ('<', only left), ('>', only right) in order; matches shorter than ``least`` count as differences."""
    left, right, out = "", "", []

    def close():
        nonlocal left, right
        if left:
            out.append(("<", left))
        if right:
            out.append((">", right))
        left = right = ""

    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal" and j - i >= least:
            close()
            out.append(("=", a[i:j]))
        else:
            left, right = left + a[i:j], right + b[k:m]
    close()
    return out


# ---- HTML -------------------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": None, "attrs": {}, "children": []}
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": dict(attrs), "children": []}
        self.open[-1]["children"].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1]["children"].append({"tag": tag, "attrs": dict(attrs), "children": []})

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1]["children"].append(data)


def parse_html(html: str) -> dict:
    """Nested {tag, attrs, children}; end tags without a start are dropped, open tags closed by their parent's end."""
    t = _Tree()
    t.feed(html or "")
    t.close()
    return t.root


def _texts(node, out: list[str]) -> list[str]:
    stack = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            if n.strip():
                out.append(n.strip())
        elif n["tag"] not in ("style", "script"):
            stack += reversed(n["children"])
    return out


def html_text(html: str | None) -> str | None:
    """The text nodes outside style and script, a line each."""
    return None if html is None else "\n".join(_texts(parse_html(html), []))


@F.pandas_udf(T.StringType())
def visible_text(s: pd.Series) -> pd.Series:
    return s.map(html_text)


def pretty_html(html: str) -> str:
    out: list[str] = []
    stack: list = [(n, 0) for n in reversed(parse_html(html)["children"])]
    while stack:
        n, depth = stack.pop()
        pad = "  " * depth
        if isinstance(n, tuple):
            out.append(pad + n[0])
        elif isinstance(n, str):
            if n.strip():
                out.append(pad + n.strip())
        else:
            attrs = "".join(f' {k}="{v}"' if v is not None else f" {k}" for k, v in n["attrs"].items())
            out.append(f"{pad}<{n['tag']}{attrs}>")
            if n["tag"] not in _VOID:
                stack.append(((f"</{n['tag']}>",), depth))
                stack += [(c, depth + 1) for c in reversed(n["children"])]
    return "\n".join(out)


def find_element(root: dict, element_id: str | None = None, tag: str | None = None) -> dict | None:
    """The first element of an id or a tag, in document order."""
    stack = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            continue
        if n["tag"] and (element_id is None or n["attrs"].get("id") == element_id) and (tag is None or n["tag"] == tag):
            return n
        stack += reversed(n["children"])
    return None


def attribute(html: Column, tag: str, name: str) -> Column:
    """An attribute of the first element of a tag."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(h):
            e = find_element(parse_html(h), tag=tag) if h else None
            return e["attrs"].get(name) if e else None

        return s.map(one)

    return run(html)


# ---- JSON -------------------------------------------------------------------------------------------


def pretty_json(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)


def compact_json(text: str) -> str:
    return json.dumps(json.loads(text), separators=(",", ":"), ensure_ascii=False)


_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[\.([A-Za-z_]\w*)\s*==?\s*(\"[^\"]*\"|[^\]]+)\]")


def json_steps(path: str) -> list:
    """Steps of a path of ``.field``, ``[3]`` and ``[.field==value]`` (the first element that fits)."""
    out, at = [], 0
    for m in _STEP.finditer(path):
        if m.start() != at:
            break
        at = m.end()
        out.append(("field", m[1]) if m[1] else ("index", int(m[2])) if m[2] else ("where", m[3], m[4].strip('"')))
    if at != len(path):
        raise ValueError(f"not a path: {path[at:]}")
    return out


def json_get(tree, path: str):
    """The node at a path; KeyError if it is missing."""
    for s in json_steps(path):
        if s[0] == "where":
            hit = [x for x in tree if isinstance(x, dict) and str(x.get(s[1])) == s[2]]
            if not hit:
                raise KeyError(path)
            tree = hit[0]
        else:
            try:
                tree = tree[s[1]]
            except (IndexError, TypeError):
                raise KeyError(path) from None
    return tree


def json_add(tree, value, name: str | None = None):
    """Add to an object (by name) or a list."""
    if isinstance(tree, dict):
        tree[name] = value
    else:
        tree.append(value)
    return tree


def json_delete(tree, at):
    del tree[at]
    return tree


def json_path(text: Column, path: str) -> Column:
    """The value at a path of a JSON text, as text; null if it is missing."""
    steps = json_steps(path)
    if all(s[0] != "where" for s in steps):
        return F.get_json_object(text, "$" + path)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            try:
                v = json_get(json.loads(t), path)
            except (KeyError, ValueError, TypeError):
                return None
            return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))

        return s.map(one)

    return run(text)
