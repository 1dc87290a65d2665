"""Natural-language identification and filtering.

A character-trigram naive Bayes model: a sparse ``(lang, gram, n)`` table plus
per-language totals. Scoring joins a text's trigram counts with the log-probabilities of
all languages and sums them per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lodestar import config
from lodestar.session import checkpoint_root, scratch_path, ship_package

# --- fixed values: ISO 639-1 codes and language names ------------------------
ISO_639_1 = """
aa Afar, ab Abkhazian, ae Avestan, af Afrikaans, ak Akan, am Amharic, an Aragonese, ar Arabic, as Assamese, av Avaric,
ay Aymara, az Azerbaijani, ba Bashkir, be Belarusian, bg Bulgarian, bi Bislama, bm Bambara, bn Bengali, bo Tibetan, br Breton,
bs Bosnian, ca Catalan, ce Chechen, ch Chamorro, co Corsican, cr Cree, cs Czech, cu Church Slavic, cv Chuvash, cy Welsh,
da Danish, de German, dv Divehi, dz Dzongkha, ee Ewe, el Greek, en English, eo Esperanto, es Spanish, et Estonian,
eu Basque, fa Persian, ff Fulah, fi Finnish, fj Fijian, fo Faroese, fr French, fy Western Frisian, ga Irish, gd Scottish Gaelic,
gl Galician, gn Guarani, gu Gujarati, gv Manx, ha Hausa, he Hebrew, hi Hindi, ho Hiri Motu, hr Croatian, ht Haitian,
hu Hungarian, hy Armenian, hz Herero, ia Interlingua, id Indonesian, ie Interlingue, ig Igbo, ii Sichuan Yi, ik Inupiaq, io Ido,
is Icelandic, it Italian, iu Inuktitut, ja Japanese, jv Javanese, ka Georgian, kg Kongo, ki Kikuyu, kj Kuanyama, kk Kazakh,
kl Kalaallisut, km Khmer, kn Kannada, ko Korean, kr Kanuri, ks Kashmiri, ku Kurdish, kv Komi, kw Cornish, ky Kirghiz,
la Latin, lb Luxembourgish, lg Ganda, li Limburgan, ln Lingala, lo Lao, lt Lithuanian, lu Luba-Katanga, lv Latvian, mg Malagasy,
mh Marshallese, mi Maori, mk Macedonian, ml Malayalam, mn Mongolian, mr Marathi, ms Malay, mt Maltese, my Burmese, na Nauru,
nb Norwegian Bokmål, nd North Ndebele, ne Nepali, ng Ndonga, nl Dutch, nn Norwegian Nynorsk, no Norwegian, nr South Ndebele, nv Navajo, ny Chichewa,
oc Occitan, oj Ojibwa, om Oromo, or Oriya, os Ossetian, pa Panjabi, pi Pali, pl Polish, ps Pushto, pt Portuguese,
qu Quechua, rm Romansh, rn Rundi, ro Romanian, ru Russian, rw Kinyarwanda, sa Sanskrit, sc Sardinian, sd Sindhi, se Northern Sami,
sg Sango, sh Serbo-Croatian, si Sinhala, sk Slovak, sl Slovenian, sm Samoan, sn Shona, so Somali, sq Albanian, sr Serbian,
ss Swati, st Southern Sotho, su Sundanese, sv Swedish, sw Swahili, ta Tamil, te Telugu, tg Tajik, th Thai, ti Tigrinya,
tk Turkmen, tl Tagalog, tn Tswana, to Tonga, tr Turkish, ts Tsonga, tt Tatar, tw Twi, ty Tahitian, ug Uighur,
uk Ukrainian, ur Urdu, uz Uzbek, ve Venda, vi Vietnamese, vo Volapük, wa Walloon, wo Wolof, xh Xhosa, yi Yiddish,
yo Yoruba, za Zhuang, zh Chinese, zu Zulu
"""
# ------------------------------------------------------------------------------
ISO_LANGUAGES = {name: alpha2 for alpha2, name in (entry.split(None, 1) for entry in ISO_639_1.split(","))}
ISO_LANGUAGES = {" ".join(name.split()): alpha2 for name, alpha2 in ISO_LANGUAGES.items()}
_BY_NAME = {name.casefold(): alpha2 for name, alpha2 in ISO_LANGUAGES.items()}


def nl_labels(langs: Sequence[str]) -> list[str]:
    """P5: language names in any case -> ``__label__xx``; an unknown name raises."""
    out = []
    for name in langs:
        alpha2 = _BY_NAME.get(name.strip().casefold())
        if alpha2 is None:
            raise LookupError(f"unknown language name {name!r}")
        out.append(f"__label__{alpha2}")
    return out


def iso_languages(spark: SparkSession) -> DataFrame:
    """P5 as a small table ``(name, alpha2)`` for joins."""
    return spark.createDataFrame(sorted(ISO_LANGUAGES.items()), "name string, alpha2 string")


def _lowered(df: DataFrame, key: Column, text: Column | str) -> DataFrame:
    return df.select(key.alias("key"), F.lower(F.col(text) if isinstance(text, str) else text).alias("text"))


def _codes(text: str | None) -> np.ndarray:
    """All overlapping character trigrams of a lower-cased text: three code points of 21 bits in one number."""
    c = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:]


_BATCH_CHARS = 1 << 20          # code points whose trigrams are counted at once


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Runs of a batch's texts of about ``_BATCH_CHARS`` code points; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > _BATCH_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _code_of(gram: Column) -> Column:
    point = [F.ascii(F.substring(gram, i, 1)).cast("long") for i in (1, 2, 3)]
    return F.shiftleft(point[0], 42).bitwiseOR(F.shiftleft(point[1], 21)).bitwiseOR(point[2])


_GRAM_ROWS = 1 << 16            # trigrams of an output batch


def _added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two trigram counts as one."""
    codes = np.concatenate([a[0], b[0]])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], np.concatenate([a[1], b[1]])[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts, starts) if len(codes) else counts


def langid_fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """L1: trigram counts per language ``(lang, gram, n)`` over whole texts, summed per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict = {}
            for rows in _slices(batch.column(1)):
                part, codes = batch.slice(rows.start, rows.stop - rows.start), {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    codes.setdefault(lang, []).append(_codes(text))
                for lang, found in codes.items():
                    counts = np.unique(np.concatenate(found), return_counts=True)
                    counted[lang] = _added(counted[lang], counts) if lang in counted else counts
            for lang, (grams, counts) in counted.items():
                for a in range(0, len(grams), _GRAM_ROWS):
                    some = grams[a:a + _GRAM_ROWS].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array([_gram(g) for g in some], pa.string()),
                                                      pa.array(counts[a:a + _GRAM_ROWS])], names=["lang", "gram", "n"])

    parts = _lowered(labelled, F.col(lang_col).cast("string"), text_col).mapInArrow(run, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _text_grams(keyed: DataFrame) -> DataFrame:
    """``key, code, n``: the different trigrams of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch.column(1)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found = [np.unique(_codes(text), return_counts=True) for text in part.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(g) for g, _ in found])
                if len(at):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(np.concatenate([g for g, _ in found])),
                                                      pa.array(np.concatenate([c for _, c in found]))], names=["key", "code", "n"])

    schema = StructType([StructField("key", keyed.schema["key"].dataType), StructField("code", LongType()), StructField("n", LongType())])
    return keyed.mapInArrow(run, schema)


def gram_weights(model: DataFrame) -> tuple[list[str], DataFrame]:
    """The model gram-major: languages in order, and ``code, weights`` with every language's log-probability.

    ``weights[i] = ln((n(lang_i, gram) + 1) / (total(lang_i) + V))`` with V distinct grams.
    """
    totals = {r["lang"]: r["total"] for r in model.groupBy("lang").agg(F.sum("n").alias("total")).collect()}   # the languages
    langs = sorted(totals)
    counts = model.groupBy("gram").agg(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"_{i}")
                                         for i, x in enumerate(langs)])
    size = model.agg(F.count_distinct("gram")).first()[0]
    weights = [F.log(F.col(f"_{i}") + 1) - F.log(F.lit(float(totals[x] + size))) for i, x in enumerate(langs)]
    return langs, counts.select(_code_of(F.col("gram")).alias("code"), F.array(*weights).alias("weights"))


MODEL_BYTES = 1 << 26           # a larger model is joined, not sent to the tasks


def _held(weights: DataFrame, n_langs: int) -> tuple[np.ndarray, np.ndarray] | None:
    """A stored gram-major model as sorted codes and a row of weights a language, if it takes ``MODEL_BYTES`` at most."""
    if weights.count() * 8 * (n_langs + 1) > MODEL_BYTES:
        return None
    table = weights.select("code", *[F.col("weights")[i].alias(f"_{i}") for i in range(n_langs)]).toArrow()
    codes = table.column("code").to_numpy()
    order = np.argsort(codes)
    return codes[order], np.stack([table.column(f"_{i}").to_numpy()[order] for i in range(n_langs)])


def _summed(texts: DataFrame, held, text_col: str, n_langs: int) -> DataFrame:
    """``texts`` with ``_0, _1, ..``: its log-probability sums a language instead of the text, null without a known trigram."""
    shared = texts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights = shared.value
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for rows in _slices(batch.column(place)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                sums, known = np.zeros((n_langs, part.num_rows)), np.zeros(part.num_rows, bool)
                for i, text in enumerate(part.column(place).to_pylist()):
                    grams, n = np.unique(_codes(text), return_counts=True)
                    at = np.minimum(np.searchsorted(codes, grams), len(codes) - 1)
                    hit = codes[at] == grams
                    known[i] = hit.any()
                    sums[:, i] = (weights[:, at[hit]] * n[hit]).sum(axis=1)        # equal weights give equal sums
                kept = [(c, part.column(j)) for j, c in enumerate(batch.schema.names) if j != place]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], *[pa.array(s, mask=~known) for s in sums]],
                                                 names=[*[c for c, _ in kept], *[f"_{i}" for i in range(n_langs)]])

    schema = StructType([*[f for f in texts.schema.fields if f.name != text_col], *[StructField(f"_{i}", DoubleType()) for i in range(n_langs)]])
    return texts.mapInArrow(run, schema)


def langid_predict(df: DataFrame, model: DataFrame, text_col: str, id_col: str | None = "row_id") -> DataFrame:
    """L2: top-1 language and its posterior per row; ``id_col`` must be unique. Without one each row stands for itself.

    ``score(lang) = sum over the row's in-vocabulary trigram occurrences of
    ln((n(lang, g) + 1) / (total(lang) + V))``, V = distinct training grams,
    uniform prior, softmax after subtracting the row maximum. Rows without an
    in-vocabulary trigram get NULL language and probability.

    Texts are counted and scored where they lie against the model, which is broadcast up to ``MODEL_BYTES``; nothing is
    shuffled but the sums of a row, and nothing at all without ``id_col``. A larger model is joined with ``(id, trigram, n)``.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, "langid-model")
    model.where(F.col("lang").isNotNull()).write.parquet(path)
    fitted = spark.read.parquet(path)
    names = [c for c in df.columns if c not in ("lang_pred", "lang_prob")]
    if fitted.isEmpty():
        return df.select(*names, F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("lang_prob"))
    langs, weights = gram_weights(fitted)
    stored = scratch_path(spark, "langid-weights")
    weights.write.parquet(stored)
    held = _held(spark.read.parquet(stored), len(langs))
    scores, best = F.array(*[F.col(f"_{i}") for i in range(len(langs))]), F.greatest(*[F.col(f"_{i}") for i in range(len(langs))], F.lit(-math.inf))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    known = F.col("_0").isNotNull()
    lang = F.when(known, F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position(scores, best).cast("int"))).alias("lang_pred")   # ties: the first code
    prob = F.when(known, F.lit(1.0) / total).alias("lang_prob")
    if held is not None and id_col is None:
        return _summed(df.select(*names, F.lower(F.col(text_col)).alias("_lowered")), held, "_lowered", len(langs)).select(*names, lang, prob)
    if id_col is None:                            # the key must stay as it is for the join below
        checkpoint_root(spark)
        df, id_col = df.select(*names, F.monotonically_increasing_id().alias("_key")).checkpoint(eager=True), "_key"
    texts = _lowered(df, F.col(id_col), text_col)
    if held is not None:
        found = _summed(texts, held, "text", len(langs)).where(known)
        sums = found.groupBy(F.col("key").alias("_id")).agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(langs))])
    else:
        met = _text_grams(texts).join(spark.read.parquet(stored), "code")
        sums = met.groupBy(F.col("key").alias("_id")).agg(*[F.sum(F.col("n") * F.col("weights")[i]).alias(f"_{i}") for i in range(len(langs))])
    pred = sums.select("_id", lang, prob)
    keyed = df.select(*dict.fromkeys([*names, id_col]))
    return keyed.join(pred, F.col(id_col) == F.col("_id"), "left").select(*names, "lang_pred", "lang_prob")


def filter_nl(df: DataFrame, langs: Sequence[str] | None, threshold: float = config.LANGID_THRESHOLD,
              lang_col: str = "lang_pred", prob_col: str = "lang_prob") -> DataFrame:
    """Keep rows whose top-1 language is requested with probability >= threshold.

    ``langs`` are language names (P5); None or empty keeps everything.
    """
    if not langs:
        return df
    codes = [lab.removeprefix("__label__") for lab in nl_labels(langs)]
    return df.where(F.col(lang_col).isin(codes) & (F.col(prob_col) >= F.lit(threshold)))
