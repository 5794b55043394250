"""Language identification of mixed-language text.

The script of a word narrows its candidate languages; hashed letter trigrams score the word under each; Viterbi with
a penalty for switching labels the words, so that runs of words become spans. A document gets the language whose
spans hold the most letters. Prediction is a map over whole texts; all documents of a batch are decoded in step, so
the work is array operations and not a loop over words.

Training takes a bounded sample of the labelled rows (`per_lang` documents a language, by hash); trigrams are hashed
to 65,536 buckets, so the model is at most 65,536 counts a language whatever the sample.

Defined results: a null text, or one without a letter, is `und` with score 0; a word in a script that no language of
the sample uses is scored under all; ties go to the language first in order; repeated rows get equal results;
without any training row everything is `und`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
#: First code points of script ranges, and what they are; a range ends where the next one starts.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
CHARS = 2_000_000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter; the number of its script."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    names = sorted({s for _, s in SCRIPTS})
    script = np.zeros(0x110000, np.int8)
    for start, name in SCRIPTS:
        script[start:] = names.index(name)
    return letter, script


def words_of(texts: list[str]):
    """Trigram bucket of each letter; first letter, document, script and size of each word; letters in order."""
    letter, script = tables()
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in low])
    alpha = letter[points]
    at = np.flatnonzero(alpha)
    if not len(at):
        return None
    padded = np.zeros(len(points) + 2, np.uint64)
    padded[1:-1] = np.where(alpha, points, 0)
    mix = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
    mix ^= mix >> np.uint64(29)
    bucket = ((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int32)
    start = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    doc = np.searchsorted(ends, at[start], side="right")
    size = np.diff(np.r_[start, len(at)])
    return bucket, start, doc, script[points[at[start]]], size


def learn(docs: DataFrame, per_lang: int = 4000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict:
    """The model, from at most about `per_lang` documents of each language (all of them where there are fewer)."""
    good = docs.select(docs[key].alias("_key"), docs[text].alias("_text"), docs[lang].alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    sizes = good.groupBy("_lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r["_lang"] for r in sizes)
    if not langs:
        return {"langs": []}
    share = {r["_lang"]: min(1.0, per_lang / r["n"]) for r in sizes}
    number = {x: i for i, x in enumerate(langs)}
    chance = F.create_map(*(F.lit(y) for x in share.items() for y in x))[F.col("_lang")]
    some = good.where(F.pmod(F.xxhash64(F.col("_key"), F.lit(7)), F.lit(1_000_000)) < chance * 1_000_000)

    def run(batches):
        for pdf in batches:
            got = words_of(pdf["_text"].tolist())
            if got is None:
                continue
            bucket, start, doc, script, size = got
            of = pdf["_lang"].map(number).to_numpy()[doc]
            code, n = np.unique(np.repeat(of, size).astype(np.int64) * BUCKETS + bucket, return_counts=True)
            yield pd.DataFrame({"what": "t", "lang": code // BUCKETS, "item": code % BUCKETS, "n": n})
            code, n = np.unique(of.astype(np.int64) * 256 + script, return_counts=True)
            yield pd.DataFrame({"what": "s", "lang": code // 256, "item": code % 256, "n": n})

    counts = some.mapInPandas(run, "what string, lang long, item long, n long").groupBy("what", "lang", "item").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((len(langs), BUCKETS))
    scripts = np.zeros((len(langs), 256))
    for what, table in (("t", grams), ("s", scripts)):
        part = counts[counts["what"] == what]
        table[part["lang"].to_numpy(), part["item"].to_numpy()] = part["n"].to_numpy()
    smooth = grams + 0.5
    logp = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)
    share_of = scripts / np.maximum(1, scripts.sum(1, keepdims=True))
    allowed = share_of >= 0.02
    allowed[:, ~allowed.any(0)] = True
    return {"langs": langs, "logp": logp, "allowed": allowed}


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float) -> np.ndarray:
    """The best label of each word, when a change of label between neighbours of a document costs `penalty`.

    scores: words by labels; doc: the document of each word, ascending. All documents advance together: step t
    handles the t-th word of every document that has one.
    """
    count = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    count = count[order]
    steps = int(count[0]) if len(count) else 0
    label = np.zeros(len(doc), np.int16)
    if not steps:
        return label
    active = np.searchsorted(-count, -np.arange(steps), side="left")  # documents with more than t words
    stay = np.ones((len(doc), scores.shape[1]), bool)
    came = np.zeros(len(doc), np.int16)
    best = scores[first[: active[0]]].astype(np.float64)
    last = np.zeros(len(count), np.int16)
    for t in range(1, steps):
        k = active[t]
        if k < len(best):
            last[k : len(best)] = best[k:].argmax(1)
            best = best[:k]
        at = first[:k] + t
        top = best.argmax(1)
        jump = best[np.arange(k), top][:, None] - penalty
        keep = best >= jump
        stay[at], came[at] = keep, top
        best = np.where(keep, best, jump) + scores[at]
        best -= best.max(1, keepdims=True)
    last[: len(best)] = best.argmax(1)
    now = last[: active[0]].copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        label[at] = now[:k]
        if t:
            now[:k] = np.where(stay[at, now[:k]], now[:k], came[at])
    return label


def label_words(texts: list[str], model: dict, penalty: float):
    """Of each word: its document, label and size; None without letters."""
    got = words_of(texts) if model["langs"] else None
    if got is None:
        return None
    bucket, start, doc, script, size = got
    scores = np.stack([np.add.reduceat(model["logp"][i][bucket], start) for i in range(len(model["langs"]))], 1)
    scores = np.where(model["allowed"][:, script].T, scores, -1e6)
    return doc, viterbi(scores, doc, len(texts), penalty), size


def groups(texts: list[str]):
    """Slices of a batch with a bounded number of characters (a longer text is a slice of its own)."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def predict(docs: DataFrame, model: dict, penalty: float = 8.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: lang_pred, score (its share of the letters) and n_spans (runs of words of one language)."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # at most 65,536 floats a language

    def run(batches):
        m = spread.value
        n_langs = len(m["langs"])
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["_text"]]
            names, score, spans = [], [], []
            for a, b in groups(texts):
                got = label_words(texts[a:b], m, penalty)
                if got is None:
                    names += ["und"] * (b - a)
                    score += [0.0] * (b - a)
                    spans += [0] * (b - a)
                    continue
                doc, label, size = got
                letters = np.zeros((b - a, n_langs))
                np.add.at(letters, (doc, label), size)
                total = letters.sum(1)
                top = letters.argmax(1)
                runs = np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]
                names += [m["langs"][i] if n else "und" for i, n in zip(top, total, strict=True)]
                score += np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0).tolist()
                spans += np.bincount(doc[runs], minlength=b - a).tolist()
            yield pd.DataFrame({key: pdf[key], "lang_pred": names, "score": score, "n_spans": spans})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {kind}, lang_pred string, score double, n_spans long")


def spans(docs: DataFrame, model: dict, penalty: float = 8.0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The spans themselves: key, seq, lang, n_words, n_letters, in order of the text."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            texts, keys = [x if isinstance(x, str) else "" for x in pdf["_text"]], pdf[key].to_numpy()
            for a, b in groups(texts):
                got = label_words(texts[a:b], spread.value, penalty)
                if got is None:
                    continue
                doc, label, size = got
                start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])])
                of = doc[start]
                yield pd.DataFrame({key: keys[a:b][of], "seq": np.arange(len(start)) - np.searchsorted(of, of), "lang": [spread.value["langs"][i] for i in label[start]], "n_words": np.diff(np.r_[start, len(doc)]), "n_letters": np.add.reduceat(size, start)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].alias("_text")).mapInPandas(run, f"{key} {kind}, seq long, lang string, n_words long, n_letters long")
