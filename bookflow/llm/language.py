"""Languages of documents and of the segments of mixed documents.

Method: multinomial naive Bayes over hashed character n-grams. The model is fitted on a bounded sample of labelled texts
(``SAMPLE`` per language and field), whose labels may be wrong (see ``fit``). Its matrix of log-probabilities has a fixed size and is sent to all tasks; texts are scored line by line, in batches, in numpy.

Cases: null and blank texts have no language and no row; lines without letters belong to no segment; a line too short to
tell takes the language of its document; repeated rows of an id count once; very long texts are scored whole; an empty
table gives an empty result; without any labelled text there is no model and an error says so; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookflow.llm import kernel as K

LANGUAGES = ("en", "ar", "fr", "es", "de", "fa", "zh")
#: Spellings of each language in labels (fixed values); a region behind "-" or "_" is cut off before.
SPELLINGS = {
    "en": ("en", "eng", "english", "anglais", "englisch"),
    "ar": ("ar", "ara", "arabic", "arb", "العربية"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castilian"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fa": ("fa", "fas", "per", "persian", "farsi", "فارسی"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文"),
}
#: Common words of each language, the first article of the declaration of human rights and a few plain sentences: they anchor the first fit, and stand in for languages without a labelled text.
ANCHORS = {
    "en": "the of and to in is that it he was for on are as with his they at be this have from not but what all were when there which she their if will all human beings are born free and equal in dignity and rights they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood the old woman walked through the village and asked the children where her brother had gone nobody answered her that night we found seven letters under the bridge chapter next previous page read more thank you for your support translated and edited by",
    "ar": "في من على إلى أن عن هذا التي الذي ما لا كان مع هو كل بعد قبل لم قد حتى هذه بين ثم عند كانت أو ولا وقد كما لكن غير تحت حين يولد جميع الناس أحرارا متساوين في الكرامة والحقوق وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء سارت المرأة العجوز في القرية وسألت الأطفال أين ذهب أخوها فلم يجبها أحد وفي تلك الليلة وجدنا سبع رسائل تحت الجسر الفصل التالي السابق اقرأ المزيد شكرا لدعمكم",
    "fr": "le la les de des du et à un une est que qui dans en il elle pour pas au sur se ce par plus avec son sa ses ne mais ou leur été cette comme tous les êtres humains naissent libres et égaux en dignité et en droits ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité la vieille femme traversa le village et demanda aux enfants où était allé son frère personne ne lui répondit cette nuit-là nous trouvâmes sept lettres sous le pont ils refusèrent jamais d'ouvrir la porte avant l'aube",
    "es": "el la los las de del y a en un una que es por con no se su para al lo como más pero sus ya este esta entre cuando muy sin sobre hasta desde todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como están de razón y conciencia deben comportarse fraternalmente los unos con los otros la anciana cruzó la aldea y preguntó a los niños adónde había ido su hermano nadie le respondió aquella noche encontramos siete cartas bajo el puente se negaron a abrir la puerta antes del amanecer llevó vendió recordó",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei wird sie nach war noch vor zum über alle menschen sind frei und gleich an würde und rechten geboren sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen die alte frau ging durch das dorf und fragte die kinder wohin ihr bruder gegangen sei niemand antwortete ihr in jener nacht fanden wir sieben briefe unter der brücke er weigerte sich die tür zu öffnen und brachte schickte verkaufte warteten erreichte",
    "fa": "و در به از که این را با است برای آن یک تا بر هم شد می خود هیچ پس پیش بود کرد گفت شود نیز اما یا ها های دیگر اگر چه تمام افراد بشر آزاد به دنیا می‌آیند و از لحاظ حیثیت و حقوق با هم برابرند همه دارای عقل و وجدان هستند و باید نسبت به یکدیگر با روح برادری رفتار کنند پیرزن از میان روستا گذشت و از کودکان پرسید برادرش کجا رفته است هیچ‌کس پاسخی نداد آن شب هفت نامه زیر پل پیدا کردیم",
    "zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待老妇人走过村庄问孩子们她的兄弟去了哪里没有人回答那天夜里我们在桥下找到了七封信",
}
#: Labelled texts per language and field that the model is fitted on, and the longest text taken.
SAMPLE, SAMPLE_CHARS = 400, 20_000
BUCKETS = 1 << 16
ANY = "*"
#: The total that each language's counts are brought to, and the number of a field's most common n-grams that show its share in a label.
SCALE, COMMON = 100_000.0, 300
#: A label borne by so large a share of a field's labelled texts is not mostly slips.
OWN = 0.05
#: Weight of the anchors in counts, and rounds of fitting.
ANCHOR, ROUNDS = 1000.0, 4
#: If less than this share of a label's n-grams is left, what is left is chance, and the anchors stand alone.
LEFT = 0.1
SMOOTHING = 0.05
#: A line is of another language than its document only if that is more likely by so many nats, and it has so many letters.
MARGIN, LEAST_LETTERS = 6.0, 6
#: One ideograph says about as much as so many letters.
IDEOGRAPH_WEIGHT = 3

TEXTS = "chapter_id long, field string, lang string, confidence double, n_lines int, langs array<struct<lang:string,n_lines:int,confidence:double>>, segments array<struct<first_line:int,last_line:int,lang:string,confidence:double>>"


def code_of(label: Column) -> Column:
    """The language that a label names, by any spelling; null for a label that names none."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))), r"[-_].*$", "")
    out = F.when(plain.isin(*SPELLINGS[LANGUAGES[0]]), LANGUAGES[0])
    for lang in LANGUAGES[1:]:
        out = out.when(plain.isin(*SPELLINGS[lang]), lang)
    return out


def names_another(label: Column) -> Column:
    """Whether a label names a language that is none of LANGUAGES (a word of letters that is no sign for "unknown")."""
    plain = F.lower(F.trim(label))
    return code_of(label).isNull() & plain.rlike(r"^[a-z]{2,3}([-_][a-z]{2,4})?$") & ~plain.isin("und", "n/a", "na", "nil", "unk", "xx", "zxx", "mul", "mis", "tbd")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashed 2- and 3-grams of all lines with letters; start of each line in them; text of each line; its number; its letters)."""
    cp, starts = K.codepoints(texts)
    k, t = np.minimum(cp, K.TOP), K.classes()
    flags = t["flags"][k]
    letter = (flags & (K.LETTER | K.MARK)) != 0
    sym = np.where(letter, t["lower"][k], 0).astype(np.uint32)
    newline = cp == 10
    keep = letter | np.concatenate(([True], letter[:-1])) | newline
    at = np.flatnonzero(keep)
    line = (np.cumsum(newline) - newline)[at]
    sym = sym[at]
    ideograph = (flags[at] & K.IDEOGRAPH) != 0
    weights = np.where(ideograph, IDEOGRAPH_WEIGHT, 1) * (sym > 0)
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    letters = np.add.reduceat(weights, first) if len(first) else np.zeros(0, np.int64)
    p1 = np.concatenate(([0], sym[:-1]))[: len(sym)].astype(np.uint32)
    p2 = np.concatenate(([0, 0], sym[:-2]))[: len(sym)].astype(np.uint32)
    p1[first] = 0
    p2[first] = 0
    p2[first[first + 1 < len(sym)] + 1] = 0
    with np.errstate(over="ignore"):
        two = (sym * np.uint32(2654435761) + p1 * np.uint32(2246822519)) ^ np.uint32(0x5BD1E995)
        tri = (two + p2 * np.uint32(3266489917)) * np.uint32(668265263)
        # an ideograph says more by its script than by its neighbour: one gram for all of them instead of the pair
        two = np.where(ideograph, np.uint32(0x7FEB352D), two * np.uint32(374761393))
    gram = np.empty((len(sym), 2), np.uint16)
    gram[:, 0] = two >> np.uint32(16)
    gram[:, 1] = tri >> np.uint32(16)
    text = np.searchsorted(starts, at[first], side="right") - 1
    breaks = np.cumsum(newline) - newline
    number = line[first] - breaks[starts[text]] if len(first) else first
    ok = letters > 0
    if ok.all():
        return gram, first, text, number, letters
    size = np.diff(np.append(first, len(sym)))
    gram = gram[np.repeat(ok, size)]
    size = size[ok]
    return gram, np.concatenate(([0], np.cumsum(size)))[: len(size)].astype(np.int64), text[ok], number[ok], letters[ok]


def scores(gram: np.ndarray, first: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Log-likelihood of every line under every language."""
    if not len(first):
        return np.zeros((0, matrix.shape[1]))
    each = matrix.take(gram[:, 0], axis=0)
    each += matrix.take(gram[:, 1], axis=0)
    return np.add.reduceat(each, first, axis=0)


def _counts(gram: np.ndarray, first: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    of = np.repeat(group, np.diff(np.append(first, len(gram)))) if len(first) else np.zeros(0, np.int64)
    return np.stack([np.bincount(gram[of == i].ravel(), minlength=BUCKETS) for i in range(n)], axis=1).astype(float)


def _logs(weights: np.ndarray) -> np.ndarray:
    """Log-probabilities per language; every language's counts are brought to one total, so smoothing favours none."""
    weights = weights * (SCALE / np.maximum(weights.sum(axis=0), 1e-9)) + SMOOTHING
    return np.log(weights / weights.sum(axis=0)).astype(np.float32)


def fit(texts: list[str], labels: list[str], fields: list[str], shares: dict[tuple[str, str], float] | None = None) -> np.ndarray:
    """The matrix of log-probabilities, buckets by languages. The label ANY marks texts taken whatever their label.

    Wrong labels matter: those of a rare language are mostly slips on texts of the common ones. A label's n-grams are
    thus a mixture of its language's and of the field's as a whole (the ANY texts). The share of the latter shows in
    those n-grams that are common in the field and rarest under the label; so much is taken off, unless ``shares`` says that
    the label is common itself. Then the lines that
    the language of their label explains best, and those of the ANY texts that one language clearly explains best, make the model."""
    shares = shares or {}
    names = [ANY, *LANGUAGES]
    n, kinds = len(names), list(FIELDS)
    group = np.array([names.index(x) for x in labels]) + n * np.array([kinds.index(f) for f in fields])
    # in slices, so that the driver never holds more than the n-grams themselves
    parts = [(g, f, group[np.array(i)[t]], le) for i, part in K.slices(list(range(len(texts))), texts) for g, f, t, _, le in [features(part)] if len(f)]
    counts = sum((_counts(g, f, gr, n * len(kinds)) for g, f, gr, _ in parts), np.zeros((BUCKETS, n * len(kinds))))
    pure = np.zeros((BUCKETS, len(LANGUAGES)))
    for f, kind in enumerate(kinds):
        field = counts[:, f * n]
        p_field = field / max(field.sum(), 1)
        common = np.argsort(-p_field)[:COMMON]
        for i, lang in enumerate(LANGUAGES):
            own = counts[:, f * n + i + 1]
            if not own.sum():
                continue
            if field.sum() and shares.get((kind, lang), 0.0) < OWN:
                slips = min(float(np.quantile(own[common] / own.sum() / p_field[common].clip(1e-12), 0.2)), 1.0)
                taken = slips * p_field * own.sum()
                left = np.maximum(own - 1.2 * taken - 3 * np.sqrt(taken), 0)
                own = left * (left.sum() >= LEFT * own.sum())
            pure[:, i] += own
    anchors, begin = features(list(ANCHORS.values()))[:2]
    words = _counts(anchors, begin, np.arange(len(LANGUAGES)), len(LANGUAGES))
    words *= ANCHOR / words.sum(axis=0)
    matrix = _logs(pure + words)
    for _ in range(ROUNDS):
        counts = np.zeros_like(pure)
        for gram, first, gr, letters in parts:
            label, s = gr % n, scores(gram, first, matrix)
            best = s.argmax(axis=1)
            two = np.partition(s, -2, axis=1)
            sure = (two[:, -1] - two[:, -2] >= np.where(best == label - 1, MARGIN, 3 * MARGIN)) & ((label == 0) | (best == label - 1)) & (letters >= LEAST_LETTERS)
            size = np.diff(np.append(first, len(gram)))
            begin = np.concatenate(([0], np.cumsum(size[sure])[:-1])).astype(np.int64)
            counts += _counts(gram[np.repeat(sure, size)], begin, best[sure], len(LANGUAGES))
        matrix = _logs(counts + words)
    return matrix


def sample(chapters: DataFrame, labels: DataFrame, per_language: int = SAMPLE) -> tuple[list[str], list[str], list[str], dict[tuple[str, str], float]]:
    """(texts, labels, fields, share of each label in its field): at most ``per_language`` texts of each label and field, and as many of any label, by hash of the id."""
    long = labels.select("chapter_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), code_of(F.col(c)).alias("lang")) for f, c in FIELDS.items()])).alias("x")).select("chapter_id", "x.field", F.explode(F.array("x.lang", F.lit(ANY))).alias("lang")).where("lang is not null")

    # 4 times as many ids as texts are wanted: a label may belong to a null text
    w = Window.partitionBy("field", "lang").orderBy(F.xxhash64("chapter_id"), "chapter_id")
    ids = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 4 * per_language).drop("rank")
    texts = chapters.select(F.col("id").alias("chapter_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.length(f) <= SAMPLE_CHARS, F.col(f)).alias("text")) for f in FIELDS])).alias("x")).select("chapter_id", "x.field", "x.text")
    w = Window.partitionBy("field", "lang").orderBy(F.xxhash64("chapter_id"), "chapter_id", "text")
    rows = (
        texts.where("text is not null")
        .join(F.broadcast(ids), ["chapter_id", "field"])  # at most 4 * per_language ids of each language and field
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= per_language)
        .select("text", "lang", "field")
        .collect()
    )
    counts = {(r["field"], r["lang"]): r["count"] for r in long.groupBy("field", "lang").count().collect()}  # a row per field and language
    shares = {(f, x): c / max(sum(counts.get((f, y), 0) for y in LANGUAGES), 1) for (f, x), c in counts.items() if x != ANY}
    return [r["text"] for r in rows], [r["lang"] for r in rows], [r["field"] for r in rows], shares


FIELDS = {"raw_text": "raw_lang", "translated_text": "translated_lang"}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _identify(ids: list, fields: list[str], texts: list[str], matrix: np.ndarray) -> Iterator[tuple]:
    gram, first, text, number, letters = features(texts)
    if not len(first):
        return
    s = scores(gram, first, matrix)
    n = len(LANGUAGES)
    # the main language: that of most letters, each line by its own best guess
    best = s.argmax(axis=1)
    by_lang = np.zeros((len(texts), n))
    np.add.at(by_lang, (text, best), letters)
    main = by_lang.argmax(axis=1)[text]
    row = np.arange(len(text))
    other = (s[row, best] - s[row, main] >= MARGIN) & (letters >= LEAST_LETTERS)
    lang = np.where(other, best, main)
    # confidence: the posterior, tempered by length, since neighbouring n-grams aren't independent
    size = np.diff(np.append(first, len(gram)))
    sure = _softmax(s / np.sqrt(size)[:, None])[row, lang]
    # sums over runs of one language within one text: the segments
    change = np.concatenate(([True], (text[1:] != text[:-1]) | (lang[1:] != lang[:-1])))
    run = np.flatnonzero(change)
    weight, lines = np.add.reduceat(letters, run), np.diff(np.append(run, len(text)))
    mass = np.add.reduceat(sure * letters, run)
    of, which = text[run], lang[run].tolist()
    first_line, last_line = number[run].tolist(), number[np.append(run[1:], len(text)) - 1].tolist()
    begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    conf = (mass / weight).tolist()
    weight, mass, lines, of = weight.tolist(), mass.tolist(), lines.tolist(), of.tolist()
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(of)]):
        if b - a == 1:
            name = LANGUAGES[which[a]]
            yield ids[of[a]], fields[of[a]], name, conf[a], lines[a], [{"lang": name, "n_lines": lines[a], "confidence": conf[a]}], [{"first_line": first_line[a], "last_line": last_line[a], "lang": name, "confidence": conf[a]}]
            continue
        total = {x: [sum(col[i] for i in range(a, b) if which[i] == x) for col in (weight, mass, lines)] for x in sorted(set(which[a:b]))}
        best_lang = max(total, key=lambda x: (total[x][0], -x))
        langs = [{"lang": LANGUAGES[x], "n_lines": n_lines, "confidence": m / w} for x, (w, m, n_lines) in total.items()]
        segments = [{"first_line": first_line[i], "last_line": last_line[i], "lang": LANGUAGES[which[i]], "confidence": conf[i]} for i in range(a, b)]
        yield ids[of[a]], fields[of[a]], LANGUAGES[best_lang], sum(mass[a:b]) / sum(weight[a:b]), sum(lines[a:b]), langs, segments


def identified(chapters: DataFrame, matrix: np.ndarray) -> DataFrame:
    """One row per text with letters: its main language and confidence, its languages, and its segments."""
    spark = chapters.sparkSession
    shared = spark.sparkContext.broadcast(matrix)  # BUCKETS x LANGUAGES floats: 1.8 MB, whatever the data
    lang = pa.struct([("lang", pa.string()), ("n_lines", pa.int32()), ("confidence", pa.float64())])
    segment = pa.struct([("first_line", pa.int32()), ("last_line", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    kinds = [("chapter_id", pa.int64()), ("field", pa.string()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_lines", pa.int32()), ("langs", pa.list_(lang)), ("segments", pa.list_(segment))]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            ids, raw, translated = (batch.column(i).to_pylist() for i in range(3))
            flat = [((i, f), x) for i, r, t in zip(ids, raw, translated) for f, x in (("raw_text", r), ("translated_text", t)) if x is not None]
            for keys, texts in K.slices([k for k, _ in flat], [x for _, x in flat]):
                rows = list(_identify([k[0] for k in keys], [k[1] for k in keys], texts, m))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], schema=schema)

    return chapters.where("id is not null").select(F.col("id").cast("long").alias("chapter_id"), "raw_text", "translated_text").mapInArrow(run, TEXTS)


def texts_with_labels(chapters: DataFrame, labels: DataFrame, matrix: np.ndarray | None = None) -> DataFrame:
    """Each text once, with its languages, its label's language, and whether the label is missing, wrong, or several languages are in it."""
    if matrix is None:
        texts, names, fields, shares = sample(chapters, labels)
        if not any(x != ANY for x in names):
            raise ValueError("no labelled text to fit the language model on")
        matrix = fit(texts, names, fields, shares)
    each = identified(chapters, matrix).groupBy("chapter_id", "field").agg(*[F.first(c).alias(c) for c in ("lang", "confidence", "n_lines", "langs", "segments")])  # the texts of one id are equal
    named = labels.select("chapter_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), code_of(F.col(c)).alias("label"), names_another(F.col(c)).alias("foreign")) for f, c in FIELDS.items()])).alias("x")).select("chapter_id", "x.*")
    named = named.groupBy("chapter_id", "field").agg(F.max("label").alias("label"), F.max("foreign").alias("foreign"))
    foreign = F.coalesce("foreign", F.lit(False))
    return each.join(named, ["chapter_id", "field"], "left").select(
        "chapter_id",
        "field",
        "lang",
        "confidence",
        "langs",
        "segments",
        "label",
        (F.col("label").isNull() & ~foreign).alias("unlabelled"),
        (F.coalesce(F.col("label") != F.col("lang"), F.lit(False)) | foreign).alias("mislabelled"),
        (F.size("langs") > 1).alias("mixed"),
    )


def found(chapters: DataFrame, labels: DataFrame, residue: DataFrame) -> DataFrame:
    """(chapter_id, field, lang) of texts without a label, with a wrong one, or of several languages; not the raw text of residue."""
    cases = texts_with_labels(chapters, labels).where("unlabelled or mislabelled or mixed").select("chapter_id", "field", F.explode("langs.lang").alias("lang"))
    out = residue.select("chapter_id", F.lit("raw_text").alias("field")).distinct()
    return cases.join(out, ["chapter_id", "field"], "left_anti")
