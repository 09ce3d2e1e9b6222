"""Page furniture mixed with main content, by two-pass block rules over lines (problem 5).

First pass, each line by itself: its link density, length and share of stop words make it *bad*, *good*, or, if it is short
and says neither, undecided. The text has no markup left, so link density is the share of items between separators, and the
likeness of the line's phrases to those of lines that a site repeats on page after page, learned from all pages: lines are
counted per site, repeated ones that do not stand between running text set against lines that occur once. Short lists of
menu entries, sidebar headings and stock phrases are a prior for sites with too few pages to learn from.

Second pass: undecided lines take their label from context. Lines under the heading of a sidebar belong to it until running
text returns; the title, and headings before running text, stay; runs of short items are menus; rows of a label and a figure
are content, and so is a sentence, perhaps cut, in a value without other content; other lines inherit from the nearer decided
neighbour, blank lines aside, where only a tie of both kinds is content.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions.sites import host_of
from cardloom.llm import residue
from cardloom.session import bounded, cut

# Frequent function words in en, de, fr, es.
STOP_WORDS = set(
    "a an and are as at be been but by did for from had has have he her his how in is it its not of on or she that the their they this to was we were what when which who will with would "
    "der die das den dem des ein eine einer eines und oder nicht mit von vom zu zum zur im in ist sind war waren wie als auch auf aus bei für um hat haben wird werden nach über sich es an am wurde wurden "
    "le la les un une des du de et ou ne pas avec dans sur par pour est sont a été au aux ce cette ces qui que se son sa ses en plus il elle à mais leur leurs nous vous ils elles entre depuis selon n l d s c qu "
    "el los las una unos y o no con del al por para es son fue que su sus lo como más en se ha han otra otro ninguna ningún hasta entre sobre desde según pero".split()
)
LONG = 70
DENSE = 0.18
#: Hashed words and word pairs of the phrases of repeated lines.
PHRASES = 1 << 17
#: A line is repeated on a site if at least so many pages have it, and this share of the site's pages; then for sentences.
REPEATED, REPEATED_SHARE = (3, 5), (0.001, 0.01)
#: Lines that stand between running text on a larger share of these pages are headings or sentences of articles.
INSIDE = (0.3, 0.2)
#: Longest line that takes part in the counts.
COUNTED = 130
#: Likeness to repeated lines from which an undecided line is link-like, and from which a sentence is.
LINKED, FIRM = 0.7, 1.6

# Entries of site menus, lower case, in en, de, fr, es.
MENU = set(
    "home|news|sign in|log in|login|register|subscribe|contact|contact us|about|about us|archive|archives|topics|maps|travel|regions|library|letters|events|shop|data|obituaries|jobs|tools|podcasts|publications|opinion|methods|weather|help|search|menu|"
    "sport|sports|business|politics|culture|science|health|video|videos|photos|careers|press|faq|sitemap|site map|imprint|privacy|terms|world|local|more|next|previous|share|print|"
    "startseite|aktuelles|anmelden|archiv|daten|kontakt|regionen|themen|über uns|wetter|suche|menü|impressum|datenschutz|agb|nachrichten|hilfe|karten|reise|"
    "accueil|actualités|archives|connexion|données|météo|régions|thèmes|à propos|contact|recherche|aide|cartes|"
    "inicio|noticias|archivo|datos|entrar|el tiempo|temas|regiones|quiénes somos|contacto|buscar|ayuda|mapas".split("|")
)
# Headings of sidebars, lower case.
SIDEBAR = set(
    "most read|most popular|most viewed|related stories|related articles|related content|related|you may also like|you might also like|trending now|trending|up next|editor's picks|editors' picks|readers also opened|readers also liked|"
    "in this section|recommended|recommended for you|latest news|latest stories|read next|read more|see also|more stories|popular now|don't miss|"
    "meistgelesen|mehr zum thema|das könnte sie auch interessieren|auch interessant|verwandte artikel|weitere artikel|empfohlen|lesen sie auch|"
    "les plus lus|à lire aussi|lire aussi|articles liés|sur le même sujet|vous aimerez aussi|"
    "lo más leído|le puede interesar|también le puede interesar|noticias relacionadas|artículos relacionados|te puede interesar|más leídas".split("|")
)
_SIDEBAR_START = re.compile(r"^(?:more (?:from|on|about)|mehr (?:von|aus)|plus (?:de|sur)|más (?:de|sobre)) ", re.I)
# Stock phrases of page furniture in en, de, fr, es.
_STOCK = re.compile(
    r"""^(?:
      (?:we|wir|nous|nosotros)\b.*\b(?:cookies?|partners?|partner|partenaires|socios)\b.*|.*\b(?:accept\ all|alle\ akzeptieren|tout\ accepter|aceptar\ todo)\b.*|we\ value\ your\ privacy.*|this\ (?:site|website|page)\ uses\ cookies.*|usamos\ cookies.*|utilizamos\ cookies.*|
      cookie\ (?:notice|settings|policy|preferences)\b.*|your\ privacy\ choices.*|tracking\ preferences.*|legitimate\ interest.*|before\ you\ continue\b.*|by\ clicking\b.*|by\ (?:using|continuing|staying)\b.*(?:agree|accept|consent).*|allow\ .*\bpartners\b.*data.*|
      .*\bsets?\ small\ files\ on\ your\ device.*|.*\bspeichert\ dateien\ auf\ ihrem\ gerät.*|diese\ (?:seite|website)\b.*\b(?:cookies|dateien)\b.*|gérer\ mes\ choix.*|.*traceurs\ publicitaires.*|elija\ qué\ datos.*|configurar\ cookies.*|do\ not\ sell\ my.*|manage\ (?:consent|options|cookies|preferences).*|
      .*\bnewsletter\b.*(?:e-?mail|every\ morning|sign\ up|subscribe|jeden\ morgen|bestellen|abonnieren)?.*|(?:enter|your)\ (?:your\ )?e-?mail.*|sign\ up\ (?:for|to)\b.*|subscribe\b.*|recevez\ notre\ lettre.*|abonnez-vous.*|reciba\ nuestro\ boletín.*|suscríbase.*|already\ a\ (?:member|subscriber).*|
      follow\ us\b.*|folgen\ sie\ uns.*|suivez-nous.*|síganos.*|share\ (?:on|this|via)\b.*|teilen\b.*|artikel\ teilen.*|partager\b.*|compartir\b.*|print\ this\ page.*|save\ for\ later.*|listen\ to\ this\ article.*|download\ our\ app.*|get\ the\ app.*|
      skip\ to\ (?:main\ )?content.*|zum\ inhalt\ springen|aller\ au\ contenu|saltar\ al\ contenido|back\ to\ top.*|nach\ oben|haut\ de\ page|volver\ arriba|loading\b.*|report\ a\ problem.*|jump\ to\b.*|
      (?:previous|next|vorheriger|nächster)\ (?:article|artikel|page)\b.*|page\ \d+\ of\ \d+|seite\ \d+\ von\ \d+|page\ \d+\ sur\ \d+|página\ \d+\ de\ \d+|
      advertisement|advertising|anzeige|werbung|publicité|publicidad|sponsored(?:\ content)?|promoted|
      [\d.,\s ]+(?:comments?|kommentare?|commentaires?|comentarios?|shares?|likes?|views?|replies|reactions?)|comments?\ \(?\d+\)?|[\d.,\s ]+people\ are\ reading.*|
      [\d.,\s ]+min(?:utes?|uten|utos)?\ (?:read|de\ lectura|lesezeit|de\ lecture)\b.*|lesezeit\b.*|temps\ de\ lecture.*|tiempo\ de\ lectura.*|(?:photo\ )?gallery\ \(\d+\)|bildergalerie.*|(?:updated|published|posted)\ \d+\ (?:minutes?|hours?|days?)\ ago.*|vote:.*|poll:.*|
      [©®].*|\(c\)\ .*|copyright\b.*|.*\ball\ rights\ reserved\b.*|.*alle\ rechte\ vorbehalten.*|.*tous\ droits\ réservés.*|.*todos\ los\ derechos\ reservados.*|reproduction\ only\ with.*|(?:nachdruck|reproduction|reproducción)\b.*(?:genehmigung|interdite|prohibida|consent|permission).*|
      .*\bis\ published\ by\b.*registered\ office.*|funded\ by\ readers\b.*|part\ of\ the\b.*\b(?:group|network)\.?|.*an\ independent\ publication\ since.*|ein\ angebot\ (?:von|der|des)\b.*|editado\ por\b.*|(?:édité|publié)\ par\b.*|une\ publication\ d.*|una\ publicación\ d.*|eine\ publikation\ (?:von|der|des)\b.*|enjoying\ this\?.*|support\ (?:us|our|independent)\b.*|helpline\b.*|hotline\b.*|customer\ service\b.*|
      .*\bsite\ map\b.*|plan\ du\ site.*|mapa\ del\ sitio.*|advertise\ with\ us.*|terms\ of\ (?:use|service)\b.*|privacy\ policy|imprint|mentions\ légales.*|aviso\ legal.*|impressum.*|corrections\ \|.*|
      \w[\w'-]*\ -?\d+\s?°.*|(?:tags?|keywords|schlagwörter|mots-clés|etiquetas)\s?:.*
    )$""",
    re.I | re.X,
)
# First words of the stock phrases above that begin with one, and words of those that may begin otherwise; lines
# with neither skip the pattern.
_FIRST = set(
    "we wir nous nosotros this usamos utilizamos cookie your tracking legitimate before by allow diese gérer elija configurar do manage enter sign subscribe recevez abonnez-vous reciba suscríbase already follow folgen suivez-nous síganos share teilen artikel partager compartir print save "
    "listen download get skip zum aller saltar back nach haut volver loading report jump previous next vorheriger nächster page seite página advertisement advertising anzeige werbung publicité publicidad sponsored promoted comment comments lesezeit temps tiempo photo gallery bildergalerie "
    "updated published posted vote poll copyright reproduction nachdruck reproducción funded part ein editado édité publié une una eine enjoying support helpline hotline customer plan mapa advertise terms privacy imprint mentions aviso impressum corrections tag tags keyword keywords "
    "schlagwörter mots-clés etiquetas newsletter c".split()
)
_INNER = set("accept akzeptieren accepter aceptar files dateien traceurs newsletter rights rechte droits derechos published independent map comment comments kommentar kommentare commentaire commentaires comentario comentarios share shares like likes view views replies reactions people min minute minutes minuten minutos".split())
_APART = str.maketrans(dict.fromkeys('|·•>/,.:;()!?"', " "))
_SEPARATORS = re.compile(r"\s+[|·•>»/‹›]\s+|\s{2,}|\t+")
_ROW = re.compile(r"^[\w\s.,%()+-]*\d[\w\s.,%()+-]*$")
_FIGURE = re.compile(r"^[^\W\d_][^\d|]*?(?:[:,]\s*|\s+\()\d[\d.,\s]*(?:%|[^\W\d_]+\.?)?\)?$")
_BULLET = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+\S")
_END = re.compile(r"[.!?…][\"”»’')\]]*$")
_WORDS = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d+")
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def _items(line: str) -> list[str]:
    return [x for x in (p.strip(" |·•>/") for p in _SEPARATORS.split(line)) if x]


def _link_density(line: str, items: list[str], lists: bool = True) -> float:
    """Share of a line's characters in link-like items: short unpunctuated items between separators, or menu entries."""
    total = sum(map(len, items)) or 1
    menu = sum(len(x) for x in items if lists and x.lower() in MENU)
    if len(items) >= 3:
        linked = sum(len(x) for x in items if len(x) <= 32 and not _END.search(x) and not x[:1].isdigit())
        return max(menu, linked) / total
    return menu / total


def _stock(bare: str, low: str) -> bool:
    words = low.translate(_APART).split()
    likely = bare[0] in "©®(" or "°" in bare or words and (words[0] in _FIRST or not _INNER.isdisjoint(words))
    return bool(likely and _STOCK.match(bare))


def _running(line: str) -> bool:
    """Four words or more, one of them in lower case: a sentence, perhaps cut, and not a name."""
    words = _WORDS.findall(line)
    return len(words) >= 4 and any(w.islower() for w in words)


def _inherited(labels: list[str]) -> list[str]:
    """Labels in which undecided lines have that of the nearer decided one, the only one at the ends; a tie of both is ``good``."""
    rows = [k for k, label in enumerate(labels) if label != "empty"]
    nearest: dict[int, list[tuple[int, str]]] = {k: [] for k in rows if labels[k] == "short"}
    for order in (rows, rows[::-1]):
        away, last = 0, ""
        for k in order:
            away += 1
            if k not in nearest:
                away, last = 0, labels[k]
            elif last:
                nearest[k].append((away, last))
    out = list(labels)
    for k, found in nearest.items():
        out[k] = "bad" if found and {label for away, label in found if away == min(found)[0]} == {"bad"} else "good"
    return out


def _same(a: str, b: str | None) -> bool:
    if not b:
        return False
    a, b = a.strip().lower(), b.strip().lower()
    return a == b or b.startswith(a) and len(a) >= 12 and b[len(a) :].lstrip()[:1] in "|–-—·"


def _masked(line: str) -> str:
    return _NUMBER.sub("0", line.strip().lower())


class Phrases(dict):
    """Code of each word or sign of a line, kept as long as there are not too many."""

    def __missing__(self, part: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[part] = zlib.crc32(part.encode())
        return code

    def keys_of(self, masked: str) -> list[int]:
        """Features of a line: its words and signs, and neighbouring pairs of them, its ends included."""
        own = [self[part] for part in _PARTS.findall(masked)]
        return [c & (PHRASES - 1) for c in own] + [(a * 31 + b * 17 + 7 >> 3) & (PHRASES - 1) for a, b in zip([1, *own], [*own, 2])]


def _without(text: str, numbers: list[int]) -> str:
    """The text without the lines of these numbers."""
    drop = set(numbers)
    return "\n".join(line for k, line in enumerate(text.split("\n"), 1) if k not in drop) if drop else text


class Rules:
    """The block rules with their caches. ``phrases`` are the log odds of :func:`learned_phrases`; without them, or without
    the fixed ``lists``, the other evidence decides alone."""

    def __init__(self, phrases: np.ndarray | None = None, lists: bool = True):
        self.phrases, self.lists = phrases, lists
        self.seen: dict[str, str] = {}
        self.codes = Phrases()

    def likeness(self, line: str) -> float:
        """Mean log odds of a line's phrases, scaled by the root of their number; 0 without learned phrases."""
        if self.phrases is None or len(line) > COUNTED:
            return 0.0
        keys = self.codes.keys_of(_masked(line))
        return float(self.phrases[keys].sum() / len(keys) ** 0.5) if keys else 0.0

    def first_pass(self, line: str, following: str) -> str:
        """``good``, ``bad``, ``like`` (bad by its phrases), ``side`` (heading of a sidebar), ``empty`` or ``short``."""
        label = self.seen.get(line)
        if label is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            label = self.seen[line] = self.by_itself(line)
        if label == "table":
            return "good" if " | " in following and _ROW.match(following.strip().replace("|", " ")) else "bad"
        return label

    def by_itself(self, line: str) -> str:
        """The label of a line, or ``table`` where the next line decides between a table's heading and a menu."""
        bare = line.strip()
        if not bare:
            return "empty"
        low = bare.lower().rstrip(":")
        if self.lists:
            if low in SIDEBAR or _SIDEBAR_START.match(bare) and not _END.search(bare):
                return "side"
            if low in MENU or _stock(bare, low):
                return "bad"
        if _SEPARATORS.search(bare):
            items = _items(bare)
            if self.lists and sum(x.lower() in MENU for x in items) >= 2:
                return "bad"
            if len(items) >= 2:
                if _ROW.match(bare.replace("|", " ")):
                    return "good"
                if _link_density(bare, items, self.lists) > 0.6:
                    return "table" if " | " in bare else "bad"
        if _BULLET.match(bare):
            return "good"
        ended = bool(_END.search(bare))
        good = ended and len(bare) >= LONG
        if not good:
            words = _WORDS.findall(low)
            density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
            good = ended and (density >= DENSE or len(words) >= 4) or density >= DENSE and len(bare) >= 100
        if len(bare) < LONG and _FIGURE.match(bare):
            return "short"
        if self.phrases is not None and self.likeness(bare) > (FIRM if good else LINKED):
            return "side" if not ended and low.count(" ") < 4 and not any(c.isdigit() for c in bare) else "like"
        return "good" if good else "short"

    def alone(self, text: str) -> bool:
        """Whether a text of one line is furniture; repetition says nothing here, as whole texts are repeated too."""
        bare = text.strip()
        low = bare.lower().rstrip(":")
        if self.lists and (low in SIDEBAR or low in MENU or _stock(bare, low)):
            return True
        return bool(_SEPARATORS.search(bare)) and _link_density(bare, _items(bare), self.lists) > 0.6 and not _ROW.match(bare.replace("|", " "))

    def furniture(self, text: str | None, title: str | None = None) -> list[int]:
        """Numbers, from 1, of the lines of a text that are not main content. Null and blank texts have none; blank lines are none."""
        if not text or text.isspace():
            return []
        lines = text.split("\n")
        if len(lines) == 1:
            return [1] if self.alone(text) else []
        labels = [self.first_pass(line, lines[i + 1] if i + 1 < len(lines) else "") for i, line in enumerate(lines)]
        n = len(lines)
        for i, line in enumerate(lines):
            if labels[i] in ("short", "bad", "like", "side") and _same(line, title) and (not self.lists or line.strip().lower() not in MENU):
                labels[i] = "good"
        i = 0
        while i < n:  # links of a sidebar
            if labels[i] == "side":
                j = i + 1
                while j < n and labels[j] in ("short", "empty", "like"):
                    last = j + 1 >= n or labels[j + 1] not in ("short", "empty", "side", "like")
                    if last and j + 1 < n and labels[j + 1] == "good" and j > i + 1 and len(lines[j].split()) <= 3 and not any(c.isdigit() for c in lines[j]):
                        break  # a heading of the text that follows
                    labels[j] = "empty" if labels[j] == "empty" else "bad"
                    j += 1
                labels[i] = "bad"
                i = j
            else:
                i += 1
        i = 0
        while i < n:  # runs of short items
            if labels[i] != "short":
                i += 1
                continue
            j = i
            while j < n and labels[j] == "short" and len(lines[j].split()) <= 3 and not any(c.isdigit() for c in lines[j]):
                j += 1
            if j - i >= 4:
                labels[i:j] = ["bad"] * (j - i)
            i = max(j, i + 1)
        labels = ["bad" if label == "like" else label for label in labels]
        body = "good" in labels
        for k in range(n):
            if labels[k] == "short" and (_FIGURE.match(lines[k].strip()) or not body and _running(lines[k])):
                labels[k] = "good"
        final = _inherited(labels)
        return [k + 1 for k in range(n) if final[k] == "bad"]

    def main_text(self, text: str | None, title: str | None = None) -> str | None:
        """The text without its furniture lines; null stays null."""
        if text is None:
            return None
        return _without(text, self.furniture(text, title))


def furniture(text: str | None, title: str | None = None) -> list[int]:
    """Furniture lines by the rules without learned phrases, see :meth:`Rules.furniture`."""
    return Rules().furniture(text, title)


def main_text(text: str | None, title: str | None = None) -> str | None:
    """The main body by the rules without learned phrases, see :meth:`Rules.main_text`."""
    return Rules().main_text(text, title)


def line_counts(cards: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(site, line, sentence, pages, inside): on how many texts of a site each short line stands, and on how many of these
    between running text; line null has the number of the site's texts. Numbers are masked unless the line is a sentence.
    Texts of one line are left out.

    Lines that are running text beyond ``COUNTED`` characters are left out, so that little more than furniture, headings
    and short sentences is shuffled, after partial sums.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(lists=False)
        for batch in batches:
            pages: Counter = Counter()
            inside: Counter = Counter()
            for field in fields:
                for site, text in zip(batch["site"], batch[field], strict=True):
                    if not text or "\n" not in text:
                        continue
                    pages[site, None, False] += 1
                    lines = text.split("\n")
                    labels = [rules.first_pass(line, lines[k + 1] if k + 1 < len(lines) else "") for k, line in enumerate(lines)]
                    full = [k for k, label in enumerate(labels) if label != "empty"]
                    found = {}
                    for at, k in enumerate(full):
                        line = lines[k]
                        if len(line) <= COUNTED and not (labels[k] == "good" and (_BULLET.match(line) or "|" in line)):
                            between = 0 < at < len(full) - 1 and labels[full[at - 1]] == labels[full[at + 1]] == "good"
                            sentence = labels[k] == "good"
                            found[line.strip().lower() if sentence else _masked(line), sentence] = between
                    for (line, sentence), between in found.items():
                        pages[site, line, sentence] += 1
                        inside[site, line, sentence] += between
            yield pd.DataFrame([(*key, n, inside[key]) for key, n in pages.items()], columns=["site", "line", "sentence", "pages", "inside"])

    sited = cards.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("site"), *fields)
    return sited.mapInPandas(count, "site string, line string, sentence boolean, pages long, inside long").groupBy("site", "line", "sentence").agg(F.sum("pages").alias("pages"), F.sum("inside").alias("inside"))


def learned_phrases(cards: DataFrame, fields: tuple[str, ...]) -> np.ndarray:
    """Log odds per hashed phrase of standing in a line that its site repeats outside running text, against one that occurs once.

    Counts cover all texts. Each line of a site counts once, however often it stands there. The result has ``PHRASES``
    entries, whatever the data.
    """
    counts = cut(line_counts(cards, fields))
    sites = counts.where(F.col("line").isNull()).select("site", F.col("pages").alias("_all"))
    least, share, inside = (F.when(F.col("sentence"), F.lit(full)).otherwise(F.lit(short)) for short, full in (REPEATED, REPEATED_SHARE, INSIDE))
    judged = counts.where(F.col("line").isNotNull()).join(bounded(sites), "site").select(
        "line", ((F.col("pages") >= least) & (F.col("pages") >= share * F.col("_all")) & (F.col("inside") <= inside * F.col("pages"))).alias("repeated"), (F.col("pages") == 1).alias("once")
    )

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, codes = np.zeros((2, PHRASES)), Phrases()
        for batch in batches:
            for kind in (0, 1):
                found = [key for line in batch["line"][batch["repeated"] == bool(kind)] for key in codes.keys_of(_masked(line))]
                sums[kind] += np.bincount(np.array(found, dtype=np.int64), minlength=PHRASES)
        at = np.nonzero(sums.sum(axis=0))[0]
        yield pd.DataFrame({"phrase": at, "once": sums[0, at], "repeated": sums[1, at]})

    rows = judged.where(F.col("repeated") | F.col("once")).select("line", "repeated").mapInPandas(tally, "phrase int, once double, repeated double")
    rows = rows.groupBy("phrase").agg(F.sum("once").alias("once"), F.sum("repeated").alias("repeated")).toArrow().to_pandas()
    out = np.zeros(PHRASES)
    if rows["repeated"].sum() and rows["once"].sum():
        smooth = 0.1
        some = np.log(rows["repeated"] + smooth) - np.log(rows["repeated"].sum() + smooth * PHRASES)
        other = np.log(rows["once"] + smooth) - np.log(rows["once"].sum() + smooth * PHRASES)
        out[rows["phrase"].to_numpy(dtype=np.int64)] = (some - other).to_numpy()
    return out


def card_furniture(cards: DataFrame, fields: tuple[str, ...] = ("supporting_text", "snippet"), lists: bool = True) -> DataFrame:
    """(ingest_idx, field, line_no): lines of ``fields`` that are not main content; values that are residue have none.

    Repeated rows are judged one by one; null, empty and blank values give nothing. The passes that learn shuffle sums only;
    the last one shuffles nothing.
    """
    model = residue.shared(cards.sparkSession, residue.fitted(cards))
    phrases = cards.sparkSession.sparkContext.broadcast(learned_phrases(cards, fields))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules, plain, words = Rules(phrases.value, lists), Rules(), residue.Words()
        for batch in batches:
            for field in fields:
                texts, titles = batch[field].tolist(), batch["title"].tolist()
                found = [rules.furniture(text, title) for text, title in zip(texts, titles, strict=True)]
                some = [k for k, lines in enumerate(found) if lines]
                bodies = [_without(texts[k], found[k]) for k in some]
                # problem 4 judges the text without the lines that fixed rules find; where little else is left, so does this
                bodies = [body if 2 * len(body) > len(texts[k]) else plain.main_text(texts[k], titles[k]) for k, body in zip(some, bodies, strict=True)]
                clean = residue.residue_scores(bodies, model.value, words) < residue.SHARE
                ids = batch["ingest_idx"].tolist()
                rows = [(ids[k], field, n) for k, ok in zip(some, clean, strict=True) if ok for n in found[k]]
                yield pd.DataFrame(rows, columns=["ingest_idx", "field", "line_no"])

    return cards.select("ingest_idx", "title", *fields).mapInPandas(find, "ingest_idx bigint, field string, line_no int")


def main_bodies(cards: DataFrame, fields: tuple[str, ...] = ("supporting_text", "snippet")) -> DataFrame:
    """Cards with ``fields`` cut down to their main body; all other columns and all rows stay as they are."""
    kinds = cards.select("title", *fields)
    phrases = cards.sparkSession.sparkContext.broadcast(learned_phrases(cards, fields))
    name = {f: f"{f}__body" for f in fields}

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        rules = Rules(phrases.value)
        return pd.DataFrame({name[f]: [rules.main_text(x, t) for x, t in zip(frame[f], frame["title"], strict=True)] for f in fields})

    schema = ", ".join(f"`{name[f]}` string" for f in fields)
    body = F.pandas_udf(keep, schema)(F.struct(*[F.col(c) for c in kinds.columns]))
    out = cards.withColumn("__bodies", body)
    return out.select(*[F.col("__bodies")[name[c]].alias(c) if c in fields else F.col(c) for c in cards.columns])
