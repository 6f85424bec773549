"""Porter's stemmer (1980) with one further rule, for the distinct words of a corpus.

Words are written with Y for a y that counts as a consonant, so that each condition of the published rules is one pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# The published suffixes and what they become, by step; of several that a word ends with the longest counts.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# Each step's suffixes, and their lengths by their last letter, longest first.
_SUFFIXES = [(set(t), {last: sorted({len(s) for s in t if s[-1] == last}, reverse=True) for last in {s[-1] for s in t}}) for t in (STEP2, STEP3, STEP4)]

_VOWEL = re.compile("[aeiouy]")
_RUNS = re.compile("[aeiouy]+[^aeiouy]+")
_SHORT = re.compile("[^aeiouy][aeiouy][^aeiouywxY]$")


def _marked(word: str) -> str:
    """word with Y for each consonant y: at the start, or behind a vowel; behind a vowel y too, but not behind another Y."""
    if "y" not in word:
        return word
    out = ""
    for part in re.split("(y)", word):
        out += "Y" if part == "y" and (not out or _VOWEL.match(out[-1])) else part
    return out


def _measure(stem: str) -> int:
    return len(_RUNS.findall(stem))


def _ending(word: str, step: int) -> str | None:
    suffixes, lengths = _SUFFIXES[step]
    return next((word[-n:] for n in lengths.get(word[-1:], ()) if word[-n:] in suffixes), None)


def _without_inflection(w: str) -> str:
    """Steps 1a to 1c: plurals, -ed and -ing, a final y."""
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif w.endswith(("ed", "ing")) and _VOWEL.search(w, 0, len(w) - (2 if w[-1] == "d" else 3)):
        w = w[: -2 if w[-1] == "d" else -3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:-1] == w[-1] and w[-1] not in "aeiouylsz" or w.endswith("yY"):
            w = w[:-1]
        elif _measure(w) == 1 and _SHORT.search(w):
            w += "e"
    return w[:-1] + "i" if w[-1:] in ("y", "Y") and _VOWEL.search(w[:-1]) else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _without_inflection(_marked(word))
    for step, table in enumerate((STEP2, STEP3)):
        end = _ending(w, step)
        if end and _measure(w[: -len(end)]):
            w = w[: -len(end)] + table[end]
    end = _ending(w, 2)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _SHORT.search(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    if len(w) > 4 and w.endswith("fi"):  # beyond the published rules: classified meets classification
        w = w[:-1]
    return w.lower()


def stems(words: DataFrame) -> DataFrame:
    """word and stem of the distinct words of words (word): a vocabulary, which grows far slower than the texts it comes from.

    A vocabulary has few bytes for the work that it is, so it is dealt to all tasks instead of the few that its bytes would get."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = batch.column(0)
            yield pa.RecordBatch.from_arrays([own, pa.array([stem(w) for w in own.to_pylist()], pa.string())], ["word", "stem"])

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.where("word is not null").select("word").distinct().repartition(tasks).mapInArrow(run, "word string, stem string")
