"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton.

Text and lexicon are folded to the same skeleton: lower case, look-alike
letters of other scripts and full-width forms as Latin letters, digits that stand for
letters as those letters (0 o, 1 i, 3 e, 4 a, 5 s, 7 t, 8 b, @ a), l as i because 1 stands
for either, white space as single blanks one for one; $ ! | count as s i i only right before
a letter, so that they stay punctuation elsewhere.  Folding keeps positions.  A term counts
where no letter or digit touches it and where it lies in no exception phrase; of terms that
overlap the longest counts.  Texts with accents are matched a second time without them, with
LEXICON alone, because accents tell words of some languages apart.  The score is the weight of the terms per hundred words.

The lexicon is LEXICON and what fit() learns from labelled documents: words that are many
times as frequent in toxic as in other ones, weighted by the logarithm of the ratio.  The
labelled sample is bounded by SAMPLE_DOCS, and the learned terms by what is in it.

Conflicting labels of a document count as toxic; null labels and labels of unknown documents
are ignored; without labels LEXICON stands alone.

Defined results: null and empty texts and texts without a term score 0 and are not listed.
Very long texts are matched whole, in time linear in their length.  Repeated rows give repeated rows, a null doc_id is carried
through, and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, shared_checkpoints, table

MIN_SCORE = 3.0  # weight per hundred words
SAMPLE_DOCS = 20_000  # labelled documents to learn from, at most
MIN_TOXIC_DOCS = 3  # labelled toxic documents that a learned term is in, at least
MIN_LOG_RATIO = 3.0
BUILT_IN = 3.0  # factor from the grades of LEXICON to log ratios
LEXICON = {
    # English
    "idiot": 2.0, "idiots": 2.0, "idiotic": 1.5, "moron": 2.0, "morons": 2.0, "moronic": 1.5, "stupid": 1.5, "stupidity": 1.0, "scum": 2.0, "scumbag": 2.5, "scumbags": 2.5,
    "loser": 1.5, "losers": 1.5, "trash": 1.0, "garbage": 0.5, "worthless": 1.5, "pathetic": 1.5, "disgusting": 1.5, "clown": 1.0, "clowns": 1.0, "imbecile": 2.0, "imbeciles": 2.0,
    "dumbass": 2.5, "jackass": 2.0, "bastard": 2.5, "bastards": 2.5, "asshole": 3.0, "assholes": 3.0, "bitch": 3.0, "bitches": 3.0, "bullshit": 2.0, "shithead": 3.0, "fucker": 3.0, "fucking": 2.0,
    "vermin": 2.0, "subhuman": 3.0, "degenerate": 2.0, "degenerates": 2.0, "retard": 3.0, "retarded": 3.0, "filth": 1.5, "filthy": 1.0, "cretin": 2.0, "halfwit": 2.0, "nitwit": 1.5, "dimwit": 1.5,
    "dork": 1.0, "numbskull": 2.0, "bonehead": 1.5, "blockhead": 1.5, "airhead": 1.5, "dunce": 1.5, "simpleton": 1.5, "nincompoop": 1.5,
    "lowlife": 2.0, "lowlifes": 2.0, "deadbeat": 1.5, "crybaby": 1.0, "weakling": 1.5, "sicko": 2.0, "pervert": 2.0, "perverts": 2.0, "psycho": 1.5, 
    "fuck": 2.0, "fucked": 2.0, "fuckers": 3.0, "motherfucker": 3.5, "motherfuckers": 3.5, "shit": 1.5, "shitty": 1.5, "bullcrap": 1.5, "crap": 1.0, "dipshit": 3.0, "douchebag": 2.5, "douche": 2.0, "prick": 2.0, "dickhead": 3.0, "wanker": 3.0, "twat": 3.0, "tosser": 2.0, "arsehole": 3.0, "slut": 3.0, "sluts": 3.0, "whore": 3.0, "whores": 3.0, "skank": 3.0, "damn you": 1.5, "screw you": 2.5, "piss off": 2.0, "sod off": 2.0, "bugger off": 1.5,
    "hate you": 2.0, "despise you": 2.0, "you disgust me": 3.0, "nobody likes you": 2.5, "waste of space": 2.5, "waste of oxygen": 3.0, "good for nothing": 1.5, "piece of trash": 3.0, "piece of garbage": 3.0, "piece of shit": 3.5, "you people make me sick": 3.0, "burn in hell": 3.0, "rot in hell": 3.5, "hope you die": 5.0, "go die": 4.0, "die in a fire": 4.0, "shut your mouth": 2.0, "inferior race": 4.0, "brain dead": 2.0, "braindead": 2.0, "mouth breather": 2.5, "knuckle dragger": 2.5,
    "kill yourself": 5.0, "drop dead": 3.0, "shut up": 1.0, "i hate you": 3.0, "go to hell": 3.0,
    # German
    "idioten": 2.0, "dummkopf": 2.0, "trottel": 2.0, "arschloch": 3.0, "abschaum": 2.5, "versager": 1.5, "wertlos": 1.0, "erbärmlich": 1.5, "widerlich": 1.5, "schwachkopf": 2.0, "drecksack": 2.5, "missgeburt": 3.0, "verpiss dich": 3.0,
    "vollidiot": 2.5, "vollidioten": 2.5, "blödmann": 2.0, "hohlkopf": 2.0, "dumpfbacke": 2.0, "mistkerl": 2.0, "dreckskerl": 2.5, "schweinehund": 2.0, "hurensohn": 3.5, "wichser": 3.0, "schlampe": 3.0, "scheiße": 1.5, "scheiss": 1.5, "beschissen": 1.5, "halt die klappe": 2.5, "halt die fresse": 3.0, "fick dich": 3.0, "ich hasse dich": 3.0, "fahr zur hölle": 3.0, "ungeziefer": 2.5, "untermensch": 4.0, "untermenschen": 4.0, "geisteskrank": 2.0, "verachtenswert": 1.5, "ekelhaft": 1.5, "jämmerlich": 1.5, "nichtsnutz": 1.5,
    # French
    "idiote": 2.0, "imbécile": 2.0, "imbéciles": 2.0, "crétin": 2.0, "connard": 3.0, "connasse": 3.0, "salaud": 2.5, "ordure": 2.0, "minable": 1.5, "pathétique": 1.5, "dégoûtant": 1.5, "ferme ta gueule": 3.0,
    "idiots finis": 2.0, "abruti": 2.0, "abrutis": 2.0, "débile": 2.0, "débiles": 2.0, "bouffon": 1.5, "bouffons": 1.5, "salope": 3.0, "salopard": 2.5, "enculé": 3.5, "enfoiré": 3.0, "pute": 3.0, "putain": 1.5, "merde": 1.5, "bâtard": 2.5, "vaurien": 1.5, "raclure": 2.5, "déchet": 1.5, "vermine": 2.5, "sous-homme": 4.0, "ta gueule": 2.5, "va te faire foutre": 3.5, "nique ta mère": 3.5, "je te hais": 3.0, "je te déteste": 2.0, "va en enfer": 3.0, "bon à rien": 1.5, "répugnant": 1.5, "méprisable": 1.5,
    # Spanish
    "idiota": 2.0, "idiotas": 2.0, "imbécil": 2.0, "imbéciles de mierda": 3.0, "estúpido": 1.5, "estúpida": 1.5, "escoria": 2.0, "patético": 1.5, "asqueroso": 1.5, "cabrón": 2.5, "gilipollas": 2.5, "mierda": 2.0, "perdedor": 1.5,
    "tarado": 2.0, "tarados": 2.0, "retrasado": 2.5, "pendejo": 2.5, "pendejos": 2.5, "cabrones": 2.5, "puta": 3.0, "puto": 3.0, "hijo de puta": 3.5, "zorra": 2.5, "maldito": 1.0, "malnacido": 2.5, "desgraciado": 1.5, "basura humana": 3.0, "alimaña": 2.5, "sabandija": 2.0, "cállate": 1.0, "cierra la boca": 2.0, "vete al infierno": 3.0, "vete a la mierda": 3.0, "te odio": 3.0, "muérete": 4.0, "das asco": 2.5, "repugnante": 1.5, "despreciable": 1.5, "cretino": 2.0, "cretinos": 2.0,
}
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "class clown", "clown fish", "circus clown", "sore loser", "the idiot by dostoevsky", "american idiot", "garbage collection", "garbage collector", "garbage truck", "pathetic fallacy", "degenerate case", "degenerate matter", "fire retarded", "flame retarded", "shut up shop", "fire retardant", "psycho analysis", "prick test", "kill process", "damn you autocorrect", "trash folder", "trash bags", "trash pickup", "garbage can", "garbage bag", "garbage disposal", "clown car", "clown shoes", "a clown fish", "the loser pays", "loser pays", "filthy rich")
SCHEMA = "doc_id bigint, score double, hits int, terms array<string>"

_ALIKE = {
    "a": "аɑαᴀ", "b": "ЬвβʙᏏ", "c": "сϲᴄ", "d": "ԁᴅɗ", "e": "еєεᴇё", "f": "ϝғ", "g": "ɡԍ", "h": "һнʜ", "i": "іιıɩїӏ|lłƚ", "j": "јϳ", "k": "кκᴋ", "m": "мᴍ", "n": "пηɴո", "o": "оοσᴏօ",
    "p": "рρᴘ", "q": "ԛ", "r": "гʀ", "s": "ѕꜱ", "t": "тτᴛ", "u": "υսᴜ", "v": "ѵνᴠ", "w": "ѡωԝᴡ", "x": "хχ", "y": "уүʏ", "z": "ᴢ",
}


def _fold_table() -> dict[int, str]:
    out: dict[int, str] = {}
    for code in [*range(0x41, 0x5B), *range(0x386, 0x3CF), *range(0x400, 0x460), *range(0x2100, 0x2150), *range(0x24B6, 0x24EA), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D6A4)]:
        base = unicodedata.normalize("NFKD", chr(code))
        base = "".join(c for c in base if not unicodedata.combining(c)).lower()
        if len(base) == 1:
            out[code] = base
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        if len(chr(code).lower()) == 1:
            out[code] = chr(code).lower()
    for to, those in _ALIKE.items():
        for c in those:
            for x in (c, c.upper()):
                if len(x) == 1 and x not in "|L":
                    out[ord(x)] = to
    out[ord("L")] = "i"
    # what folds to a letter that folds again
    for code, c in list(out.items()):
        out[code] = out.get(ord(c), c)
    out |= {ord(a): b for a, b in zip("013457" + "8@", "oieast" + "ba")}
    out |= {ord(c): " " for c in "\t\n\r\x0b\x0c   　"}
    return out


def _accents() -> dict[int, str]:
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0].lower()
        if base.isascii():
            out[code] = "i" if base == "l" else base
    return out | {ord("ø"): "o", ord("Ø"): "o"}


FOLD = _fold_table()
ACCENTS = _accents()
_SYMBOL = re.compile(r"[$!|](?=\w)")
_WORDS = re.compile(r"[^\W_]+")
_SYMBOLS = {"$": "s", "!": "i", "|": "i"}


def fold(text: str) -> str:
    """The skeleton of a text, of the same length."""
    out = text.translate(FOLD)
    if "$" in out or "!" in out or "|" in out:
        out = _SYMBOL.sub(lambda m: _SYMBOLS[m.group()], out)
    return out


def automaton(lexicon: dict[str, float], exceptions: tuple[str, ...], accents: bool = True) -> ahocorasick.Automaton:
    """Folded terms and phrases; terms that fold alike share the larger weight."""
    found: dict[str, tuple[str, float | None]] = {}
    for term, weight in sorted(lexicon.items()):
        key = fold(term) if accents else fold(term).translate(ACCENTS)
        if key and (key not in found or found[key][1] < weight):
            found[key] = (term, weight)
    for phrase in exceptions:
        if fold(phrase):
            found[fold(phrase)] = (phrase, None)
    out = ahocorasick.Automaton()
    for key, (term, weight) in found.items():
        out.add_word(key, (len(key), term, weight))
    if found:
        out.make_automaton()
    return out


def machines(lexicon: dict[str, float], exceptions: tuple[str, ...]) -> list[ahocorasick.Automaton]:
    """The automaton of the whole lexicon, and that of LEXICON's terms for texts without their accents."""
    return [automaton(lexicon, exceptions), automaton({k: v for k, v in lexicon.items() if k in LEXICON}, exceptions, False)]


def _places(skeleton: str, machine: ahocorasick.Automaton, found: list, free: list) -> None:
    if not len(machine):
        return
    for last, (n, term, weight) in machine.iter(skeleton):
        a, b = last - n + 1, last + 1
        if (a and skeleton[a - 1].isalnum()) or (b < len(skeleton) and skeleton[b].isalnum()):
            continue
        (found if weight is not None else free).append((a, b, term, weight))


def matches(text: str, both: list[ahocorasick.Automaton]) -> list[tuple[int, int, str, float]]:
    """(start, end, term, weight) of the terms that count in a text, from left to right."""
    skeleton = fold(text)
    found: list[tuple[int, int, str, float]] = []
    free: list[tuple[int, int, str, None]] = []
    _places(skeleton, both[0], found, free)
    if not skeleton.isascii():
        _places(skeleton.translate(ACCENTS), both[1], found, free)
    if free:
        # a term lies in a phrase if the phrases that begin no later reach as far as its end
        free.sort(key=lambda m: m[:2])
        begins, reach = [m[0] for m in free], list(accumulate((m[1] for m in free), max))
        found = [m for m in found if not (at := bisect_right(begins, m[0])) or reach[at - 1] < m[1]]
    # the longest first; one that overlaps a term taken before it, in sorted order, touches its neighbour
    out: list[tuple[int, int, str, float]] = []
    for m in sorted(set(found), key=lambda m: (m[0] - m[1], m[0], m[2])):
        at = bisect_left(out, m)
        if (at == 0 or out[at - 1][1] <= m[0]) and (at == len(out) or m[1] <= out[at][0]):
            out.insert(at, m)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, float]:
    """LEXICON with the terms learned from the sample_docs labelled documents of lowest id hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    sample = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    # the sample has sample_docs rows of two numbers, whatever the input's size
    rows = docs_of(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("id")).select("toxic", "text").where("text is not null")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_WORDS.findall(fold(t)))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.string()))], names=["toxic", "words"])

    texts = rows.mapInArrow(folded, "toxic int, words array<string>").checkpoint()
    total = texts.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    bad, good = total["t"] or 0, total["n"] - (total["t"] or 0)
    found = dict(LEXICON)
    out = {k: v * BUILT_IN for k, v in found.items()}
    if bad and good:
        counts = texts.select("toxic", F.explode("words").alias("word")).where("length(word) > 2").groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).where(F.col("t") >= MIN_TOXIC_DOCS)
        ratio = F.log(((F.col("t") + 0.5) / (bad + 1)) / ((F.col("n") - F.col("t") + 0.5) / (good + 1)))
        for r in counts.select("word", ratio.alias("w")).where(F.col("w") >= MIN_LOG_RATIO).collect():
            out[r["word"]] = max(out.get(r["word"], 0.0), r["w"])
    return out


def toxic(docs: DataFrame, lexicon: dict[str, float] = LEXICON, exceptions: tuple[str, ...] = EXCEPTIONS, min_score: float = MIN_SCORE) -> DataFrame:
    """(doc_id, score, hits, terms) of the documents whose score is at least min_score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = machines(lexicon, exceptions)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = matches(text, both) if text else []
                if found:
                    score = 100 * sum(m[3] for m in found) / len(text.split())
                    if score >= min_score:
                        rows.append((doc_id, score, len(found), sorted({m[2] for m in found})))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.string())))], names=["doc_id", "score", "hits", "terms"])

    return docs_of(docs).mapInArrow(run, SCHEMA)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shared_checkpoints(spark)
    return toxic(docs, fit(docs, table(spark, sf_dir, "labels")))
