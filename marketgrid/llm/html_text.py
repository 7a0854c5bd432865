"""Main text of web pages by two passes over their blocks.

A page is cut at tags into blocks of text.  Pass one decides every block on
its own:

* *out* if it stands in a menu, header, footer, sidebar, notice, advert, form,
  share bar or comment list (by element, role, class or id), if it is not
  shown (hidden, aria-hidden, a style of display:none or visibility:hidden), if
  it follows a heading that says comments, up to the next heading of that
  level, if most of its characters are link text, or if it holds a copyright
  sign outside an article;
* *in* if it is long enough and dense in stop words;
* *open* otherwise: short blocks, headings, text with few stop words.

The stop words are of four languages.  On a page whose text holds hardly any of
them, whatever its language, length and link density decide alone: a block that is
not short and has few links is *in*.  So they do on a page where no block is
sure to be *in*.  A character of a script without spaces weighs as much
as ``WIDE`` others.

A class, id or role marks furniture if one of its words does as a whole: a word
of the list, or several joined by hyphens of which each is in that list or in
the list of parts of a layout ("comment-list", but not "comment-free").

Pass two gives an open block the label of the nearest decided neighbours: both
sides agree, or the nearer one wins, at equal distance *out*.  A page with an
<article> or <main> element is judged inside those elements only; there a
neighbour counts if it lies in the same element and was decided by its text,
and an open block is *out* only between two neighbours that are.

Script, style and other unseen content is never text.  Character references
are decoded, white space inside a block becomes one space, and blocks are
joined by a newline.

Edge cases: null or empty html gives ''; an unclosed tag, comment or script at
the end of a cut-off page is dropped with what it opened; repeated rows are
treated alike.  Pages are handled whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Frequent function words.
STOP_WORDS = frozenset("""
a about after all also an and any are as at be been but by can could did do for from had has
have he her his how i if in into is it its just like more most my no not of on one only or other
our out over she so some such than that the their them then there these they this to too up us
very was we were what when which who will with would you your
aber als am an auch auf aus bei bin bis da das dass dein dem den der des die doch du durch ein
eine einem einen einer er es euch für hat hatte ich ihr im in ist ja kein mit nach nicht noch nur
ob oder ohne sein sich sie sind so über um und uns von vor war was wenn wer wie wir zu zum zur
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais
me même mes moi mon ne nos notre nous on ou où par pas plus pour qu que qui sa sans se ses si son
sont sur ta te tu un une vos votre vous y
al algo como con cual cuando de del desde donde el ella ellos en entre era es esa ese eso esta
este esto fue ha hay la las le les lo los más me mi muy nada ni no nos o para pero por porque que
quien se ser si sin sobre son su sus también tan te tiene todo tu un una uno y ya yo
""".split())

#: Element names.
_UNSEEN = ("script", "style", "template", "noscript", "iframe", "object", "svg", "title",
           "textarea", "head", "select", "canvas", "math")
_RAW = ("script", "style", "title", "textarea", "noscript", "iframe")
_OUTSIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset"}
_MAIN = {"article", "main"}
_BLOCKS = frozenset("""address article aside blockquote body button caption center dd details
dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend
li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
_NESTED = frozenset("""a article aside blockquote body button center details dialog div dl
fieldset figure footer form header html main menu nav ol section span summary table ul
""".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Words in a class, id or role that mark page furniture.
_MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo banner
nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies
consent gdpr notice alert popup modal newsletter subscribe signup login share sharing social related
recommended comment comments reply replies disqus widget search toolbar copyright legal pager
pagination complementary contentinfo dialog""".split())
#: Words that name a part of a layout and may be joined to those.
_PARTS = frozenset("""area author bar block body bottom box btn button buttons card cell col column
container content count date desktop entry entries field footer form global group header holder icon
icons inner item items js left link links list main meta mobile module outer overlay page panel post
posts primary right row secondary section site slot small sticky tab tabs text thread title top unit
user wrap wrapper zone""".split())
_UNSHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)",
                      re.I)
#: Headings of reader comments.
_COMMENT_HEADS = frozenset("""comment comments commentaire commentaires comentario comentarios kommentar
kommentare discussion responses replies""".split()) | {
    "reader comments", "user comments", "leave a comment", "post a comment", "write a comment",
    "leave a reply", "add a comment", "leserkommentare", "kommentar schreiben", "laisser un commentaire",
    "deja un comentario", "deja una respuesta"}
#: One attribute; its value is consumed, so nothing is looked for inside it.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>"""
                  r"""|[!?][^>]*(?:>|$)|/?[a-zA-Z][^>]*(?:>|$))""", re.S)
_LETTERS = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200              # characters
DENSE, SPARSE = 0.32, 0.15         # share of stop words
LINKS, FEW_LINKS = 0.5, 0.2        # share of link characters
#: Share of stop words in a page's text below which the lists do not know its language.
STRANGE = 0.06
WIDE = 3                           # characters that one of an unspaced script stands for
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


def marks(value: str) -> bool:
    """Whether a class, id or role marks furniture."""
    for word in value.lower().split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[_-]+", word) if p.rstrip("0123456789")]
        if any(p in _MARKS for p in parts) and all(p in _MARKS or p in _PARTS for p in parts):
            return True
    return False


class Block:
    """``heading``: level of a heading, 0 for other blocks."""
    __slots__ = ("text", "links", "place", "out", "heading")

    def __init__(self, text, links, place, out, heading):
        self.text, self.links, self.place = text, links, place
        self.out, self.heading = out, heading


def attributes(inside: str) -> dict[str, str]:
    """Lower-cased names and values of a tag's attributes; of a name given
    twice the first counts."""
    given: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(inside):
        value = a[2] or ""
        given.setdefault(a[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return given


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order; ``place`` is 0 outside article/main, else
    a number per such element."""
    found: list[Block] = []
    words: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, int]] = []      # (element, marked out, place)
    out, place, places, in_link, heading, item_out = False, 0, 0, 0, 0, False
    pos, end, skip = 0, len(html), ""

    def close() -> None:
        nonlocal words, links
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                linked = "".join(unescape("".join(links)).split())
                found.append(Block(text, len(linked), place, out or item_out, heading))
        words, links = [], []

    while pos < end:
        if skip:                                 # inside unseen content
            stop = re.compile(rf"</{re.escape(skip)}(?=[\s/>])[^>]*>", re.I).search(html, pos)
            if stop is None:
                break
            pos, skip = stop.end(), ""
            continue
        m = _TAG.search(html, pos)
        text = html[pos:m.start() if m else end]
        if text:
            words.append(text)
            if in_link:
                links.append(text)
        if m is None:
            break
        pos, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            words.append(" ")
        if name in _BLOCKS:
            close()
            item_out, heading = False, 0
        if m[1]:                                 # an end tag
            if name in _NESTED:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name != "a" and name != "span":
                            close()
                        del stack[k:]
                        out = stack[-1][1] if stack else False
                        place = stack[-1][2] if stack else 0
                        in_link = sum(s[0] == "a" for s in stack)
                        break
            continue
        if name in _UNSEEN:
            if not m[3].endswith("/"):
                skip = name
            continue
        if name in _VOID:
            continue
        marked = name in _OUTSIDE and not (name == "header" and place)
        if m[3]:
            given = attributes(m[3])
            if ("hidden" in given or given.get("aria-hidden", "").strip().lower() == "true"
                    or _UNSHOWN.search(given.get("style", ""))):
                marked = True
            elif name not in ("body", "html", "article", "main"):
                marked = marked or any(marks(given[k]) for k in ("class", "id", "role") if k in given)
        if name in _NESTED:
            if name in _MAIN and not place:
                places += 1
                place = places
            out = out or marked
            stack.append((name, out, place))
            in_link += name == "a"
        elif name in _BLOCKS:
            item_out = marked
            heading = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else 0
    close()
    return found


def _without_comments(page: list[Block]) -> None:
    """Mark a heading of comments out, with what follows up to the next
    heading of its level or above in the same place."""
    level, place = 0, 0
    for b in page:
        if level and (b.place != place or 0 < b.heading <= level):
            level = 0
        if b.heading and not level and re.sub(r"[\W\d_]+", " ", b.text.lower()).strip() in _COMMENT_HEADS:
            level, place = b.heading, b.place
        if level:
            b.out = True


def _stop_share(page: list[Block]) -> float:
    """Share of stop words in the text of blocks that are not out already."""
    words = [w for b in page if not b.out and b.links <= LINKS * len(b.text)
             for w in _LETTERS.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 1.0


def _decide(b: Block, strange: bool) -> bool | None:
    """True: in, False: out, None: open.  ``strange``: no language of the
    stop words."""
    size = len(b.text)
    if b.out or b.links > LINKS * size:
        return False
    if not b.place and ("©" in b.text or "all rights reserved" in b.text.lower()):
        return False
    if b.heading or size < SHORT and not strange:
        return None
    if strange:
        weight = size + (WIDE - 1) * len(_UNSPACED.findall(b.text))
        return True if weight >= SHORT and b.links <= FEW_LINKS * size else None
    found = _LETTERS.findall(b.text.lower())
    share = sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0
    if share >= DENSE or share >= SPARSE and size >= LONG:
        return True
    if share < SPARSE and size >= LONG and not b.place:
        return False
    return None


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    if any(b.place for b in page):
        page = [b for b in page if b.place]
    _without_comments(page)
    strange = _stop_share(page) < STRANGE
    labels = [_decide(b, strange) for b in page]
    if True not in labels:                       # nothing sure: what is not short and has few links
        labels = [True if x is None and not b.heading and len(b.text) >= SHORT
                  and b.links <= FEW_LINKS * len(b.text) else x for b, x in zip(page, labels)]
    n, far = len(page), len(page) + 1

    def nearest(order) -> list[tuple[int, bool | None]]:
        got, last, label, place = [(far, None)] * n, 0, None, None
        for k in order:
            if page[k].place != place:
                label, place = None, page[k].place
            if labels[k] is not None and not (page[k].out and place):
                last, label = k, labels[k]
            got[k] = (abs(k - last), label) if label is not None else (far, None)
        return got

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    kept = []
    for k, b in enumerate(page):
        label = labels[k]
        if label is None:
            (d0, l0), (d1, l1) = before[k], after[k]
            if b.place:                          # in an article both sides must be out
                label = not (l0 is False and l1 is False)
            else:
                label = bool(l0 if d0 < d1 else l1 if d1 < d0 else l0 and l1)
                if b.heading and l1 is not None:
                    label = l1                   # a heading belongs to what follows
        if label:
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([main_text(h) for h in texts(b, "html")],
                                                    pa.string())], names=["page_id", "url", "text"])

    return (pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url",
                         F.coalesce("html", F.lit("")).alias("html"))
            .mapInArrow(run, "page_id bigint, url string, text string"))
