"""Abusive, hateful or sexual content, by compression distance.

Two zstandard dictionaries are trained, one on abusive windows and one on ordinary windows of reviewed documents. A
window of text that the abusive dictionary compresses better than the ordinary one, by more than a calibrated share,
marks its document. A window is a sentence or a line after its spelling was undone (white space, digits for letters,
stars, repeated letters).
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bound on the reviewed documents that are read for training: those of the smallest hash of doc_id.
MAX_REVIEWED = 8_000
#: Bound on the characters of all of them, so that the driver holds some tens of MB.
TRAINING_CHARS = 1 << 25
#: What a dictionary may hold; content of least weight gives way.
DICTIONARY_BYTES = 1 << 19
LEVEL = 12
#: A window joins a dictionary if what came before compresses it to no less than this share.
NOVEL = 0.3
FOLDS = 3
#: Words (characters of Chinese) of a window; longer sentences are cut into windows that overlap by half.
SPAN = 16
#: Log odds from which a window of a reviewed document counts as abusive: one of these, whichever predicts unseen labels better.
EVIDENCE = (1.5, 2.5)
#: Sentences, and windows, that a worker remembers, and the longest that is.
MEMO, MEMO_CHARS = 100_000, 200
#: Share of reviews that are taken to be wrong.
NOISE = 0.1

# Phrases in the four languages that stand for either class where few documents were reviewed.
ABUSIVE_SEED = """you are an idiot; you stupid moron; shut up you bastard; what an asshole you are; you worthless piece of shit;
go to hell you bitch; fuck you; fuck off; you fucking cunt; you are a disgusting pig; nobody likes you, loser; you dumbass;
i will kill you; i am going to beat you up; i know where you live; i will break your bones; go kill yourself; you should die;
those people are vermin; they are all criminals and should be thrown out; women are too stupid for this; foreigners are parasites;
send me nudes; i want to fuck you; show me your tits; suck my dick; free porn and naked girls; spread your legs; your pussy is wet;
du bist ein idiot; halt die fresse, du arschloch; verpiss dich, du wichser; du dumme sau; fick dich; ich bringe dich um; ich weiss wo du wohnst;
auslander sind parasiten; frauen sind zu dumm dafur; diese leute gehoren vernichtet; zeig mir deine titten; ich will dich ficken; du hurensohn;
eres un idiota; callate, imbecil; vete a la mierda, hijo de puta; eres una puta inutil; te voy a matar; se donde vives; te voy a romper la cara;
los inmigrantes son una plaga; las mujeres son inutiles; esa gente es basura; quiero follarte; mandame fotos desnuda; chupame la polla;
你是个白痴; 闭嘴你这个废物; 去死吧; 操你妈; 你这个蠢猪; 傻逼; 我要杀了你; 我知道你住哪里; 打断你的腿; 外国人都是骗子; 女人都是蠢货; 这些人都该死; 给我发裸照; 想跟你上床; 婊子"""
ORDINARY_SEED = """the policy forbids insults, threats and sexual messages; a report on harassment at work was published; the user was banned for insulting others;
that was a stupid mistake of mine; i am such an idiot, i forgot the file; this software is garbage; the stupid printer broke again; damn, missed the close;
kill the process and restart the slave server; the master node executes the job; naked short selling is banned; a dead cat bounce; dirty price and clean price;
the abuse of market power was examined; violence in the region hurt trade; statistics by sex and age; a study of hate speech and discrimination;
beleidigungen sind verboten; der prozess wurde beendet; ich idiot habe die datei vergessen; ein bericht uber gewalt und diskriminierung;
los insultos estan prohibidos; que tonto soy, se me olvido; informe sobre acoso y discriminacion; maldita sea, perdi el cierre;
禁止辱骂和威胁; 我真笨忘了保存; 这个程序是垃圾; 关于骚扰和歧视的报告; 终止进程; 裸卖空被禁止"""

_UNSEEN = re.compile(f"[{re.escape(''.join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, 0xAD, *range(0, 9), *range(14, 32)])))}]+")
_CUT = re.compile(r"(?<=[.!?;])[\s\"'”’»)]+|(?<=[.!?。！？；])(?=[\u4e00-\u9fff])|(?<=[。！？；])|[\r\n\v\f\u2028\u2029]+|[。；]")
#: The same for ASCII.
_END, _LINES = re.compile(r"([.!?;])[\s\"')]+"), re.compile(r"[\r\n\v\f]+")
_CODE = re.compile(r"(?<![a-z0-9])(?:[a-z]{2}\d{4,}|ev-\d+)(?![a-z0-9])")
_CHAT = re.compile(r"^\[\d\d:\d\d\] *\w+: *|^[>#\-*\s]+")
_CHAT_STARTS = frozenset("[>#-*")
_INSTANT = re.compile(r"\b\d{4}-\d\d-\d\d[t ][\d:.]+z?")
_NUMBER = re.compile(r"\d(?<![a-z\d]\d)[\d.,:/\-]*+(?![a-z])")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[a-z0-9@$*][ .\-_·]){3,}[a-z0-9@$*]+(?![^\W\d_])|(?<![^\W\d_])(?:[a-z*][.\-_·]){2,}[a-z*]+(?![^\W\d_])")
_CJK_GAP = re.compile(r"(?<=[\u4e00-\u9fff])[\s*._·\-]+(?=[\u4e00-\u9fff])")
_RUN = re.compile(r"([a-z])\1{2,}")
_HAN = "\u4e00-\u9fff"
#: A word, or a character of Chinese.
_UNIT = re.compile(rf"[{_HAN}]|[^\W_{_HAN}]+(?:\*+[^\W_{_HAN}]+)*")
#: Words in which something stands for a letter.
_LEET_WORD = re.compile(r"(?<![a-z0-9@$])(?=[a-z]*[0-9@$!|])[a-z0-9@$](?:[a-z0-9@$]|[!|](?=[a-z0-9]))*")
_DIGIT = re.compile(r"\d")
_MAY_BE_CODE = re.compile(r"[a-z]\d{4}|ev-\d")
_STANDS_IN = re.compile(r"[0-9@$!|]")
_SEPARATED = re.compile(r"[a-z0-9@$*][ .\-_·][a-z0-9@$*][ .\-_·]")
_LEET = str.maketrans("013457@$!|", "oieastasil")
_ALIKE = str.maketrans("аеорсхуіѕјԁɡһκνο", "aeopcxyisjdghkvo")
_HAS_ALIKE = re.compile("[аеорсхуіѕјԁɡһκνο]")


class _Marks(dict):
    """For str.translate: drops combining marks."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.combining(chr(c)) else c
        return self[c]


_NO_MARKS = _Marks()


def _unleet(match: re.Match) -> str:
    word = match.group()
    if len(word) < 3:
        return word
    letters = sum(c.isalpha() for c in word)
    if letters in (0, len(word)) or len(word) < 3 or letters < 2 and len(word) < 4:
        return word
    return word.translate(_LEET)


def plain_windows(text: str | None) -> list[str]:
    """The windows of a whole text, spelled plainly. Null, empty and blank texts have none."""
    sentences, han = _sentences(text)
    return [w for s in sentences for w in _plain(s, han)]


def _sentences(text: str | None) -> tuple[list[str], bool]:
    """Sentences and lines of a text without case, marks and look-alikes, and whether it has spaced Chinese characters."""
    if not text:
        return [], False
    text = _UNSEEN.sub("", text)
    if text.isascii():
        return _LINES.split(_END.sub(r"\1\n", text.lower())), False
    text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower()).translate(_NO_MARKS)
    text = unicodedata.normalize("NFC", text.translate(_ALIKE) if _HAS_ALIKE.search(text) else text)
    return _CUT.split(text), _CJK_GAP.search(text) is not None


def _plain(window: str, han: bool) -> list[str]:
    """Windows of one sentence or line. han: the text has spaced Chinese characters."""
    window = window.strip()
    if window[:1] in _CHAT_STARTS:
        window = _CHAT.sub("", window)
    digits = _DIGIT.search(window) is not None
    if digits:
        if "-" in window:
            window = _INSTANT.sub("0", window)
        if _MAY_BE_CODE.search(window):
            window = _CODE.sub("xx", window)
    if han:
        window = _CJK_GAP.sub("", window)
    if _SEPARATED.search(window):
        window = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m.group()), window)
    if digits:
        window = _NUMBER.sub("0", window)
    if _STANDS_IN.search(window):
        window = _LEET_WORD.sub(_unleet, window)
    window = _RUN.sub(r"\1", window)
    words = _UNIT.findall(window)
    if not words:
        return []
    parts = [" ".join(words[i : i + SPAN]) for i in range(0, max(1, len(words) - SPAN // 2), SPAN // 2)]
    return parts if window.isascii() else [_CJK_GAP.sub("", p) for p in parts]


def _pieces(window: str) -> list[str]:
    """Three units in a row; shorter windows are one piece."""
    units = _UNIT.findall(window)
    return [" ".join(units[i : i + 3]) for i in range(max(1, len(units) - 2))]


@dataclass
class CompressionModel:
    """Two dictionaries, the words that stars may hide, and the threshold."""

    abusive: bytes
    ordinary: bytes
    words: dict[int, list[str]] = field(default_factory=dict)
    threshold: float = 0.1

    def __post_init__(self) -> None:
        self._ready: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _compressors(self):
        if self._ready is None:
            make = lambda data: zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dictionary(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            self._ready = make(self.abusive), make(self.ordinary)
        return self._ready

    def unstar(self, window: str) -> str:
        if "*" not in window:
            return window
        return " ".join(self._guess(w) if "*" in w else w for w in window.split(" "))

    def _guess(self, word: str) -> str:
        pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in word))
        return next((w for w in self.words.get(len(word), ()) if pattern.fullmatch(w)), word)

    def distance(self, window: str) -> float:
        """By how much of its ordinary length a window is shorter with the abusive dictionary: -1 to 1."""
        a, o = self._compressors()
        data = self.unstar(window).encode() + _PAD
        x, y = len(a.compress(data)) - _FRAME, len(o.compress(data)) - _FRAME
        return (y - x) / max(x, y, 1)

    def score(self, text: str | None) -> float:
        """The greatest distance of a text's windows; -1 if it has none."""
        return self.remembering()(text)

    def remembering(self) -> Callable[[str | None], float]:
        """score for many texts: sentences and windows that were met before are looked up."""
        sentences_known: dict[str, float] = {}
        windows_known: dict[str, float] = {}

        def look(known: dict[str, float], key: str, find: Callable[[], float]) -> float:
            found = known.get(key)
            if found is None:
                found = find()
                if len(key) <= MEMO_CHARS:
                    if len(known) >= MEMO:
                        known.clear()
                    known[key] = found
            return found

        def of_window(w: str) -> float:
            return look(windows_known, w, lambda: self.distance(w))

        def of_text(text: str | None) -> float:
            sentences, han = _sentences(text)
            if han:
                return max((of_window(w) for s in sentences for w in _plain(s, han)), default=-1.0)
            return max((look(sentences_known, s, lambda s=s: max(map(of_window, _plain(s, False)), default=-1.0)) for s in sentences), default=-1.0)

        return of_text


#: After each window, so that even a short one is worth compressing; a match costs the same with either dictionary.
_PAD = b"\n" + b"-" * 64
_FRAME = len(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False).compress(_PAD))


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _novel(windows: list[str], step: int = 100) -> list[str]:
    """Of windows by falling weight, those that the ones before them (but for their own step's) don't already spell."""
    held: list[str] = []
    for i in range(0, len(windows), step):
        own = zstandard.ZstdCompressor(level=3, dict_data=_as_dictionary("\n".join(held).encode()[-DICTIONARY_BYTES:] or b"-" * 8), write_content_size=False, write_dict_id=False)
        for w in windows[i : i + step]:
            data = w.encode()
            if len(own.compress(data)) > NOVEL * len(data) + 9:
                held.append(w)
    return held


def train_dictionary(windows: Counter) -> bytes:
    """A zstandard dictionary of the windows: what repeats is held once, the commonest last, where matches cost least.

    zstandard's own trainer leaves out some of the common content of either class, and what a dictionary lacks speaks
    for the other one; so content is chosen by compression here, and all of it is kept up to DICTIONARY_BYTES.
    """
    return "\n".join(reversed(_novel([w for w, _ in windows.most_common()]))).encode()[-DICTIONARY_BYTES:] or b"-" * 8


def _seed(text: str) -> list[str]:
    return [w for part in text.replace("\n", " ").split(";") for w in plain_windows(part.strip())]


class _Evidence:
    """Log odds of an abusive label for documents that hold a window's pieces: tells which windows of a document its label is about."""

    def __init__(self, documents: list[tuple[list[str], bool]], memo: dict[str, list[str]]):
        self.memo = memo
        self.yes: Counter = Counter()
        self.no: Counter = Counter()
        for windows, abusive in documents:
            (self.yes if abusive else self.no).update(set().union(*map(self.pieces, windows)))
        self.share = min(0.5, max(0.05, sum(y for _, y in documents) / max(1, len(documents))))
        for seed, to in ((ABUSIVE_SEED, self.yes), (ORDINARY_SEED, self.no)):
            for window in _seed(seed):
                to.update(2 * _pieces(window))

    def pieces(self, window: str) -> list[str]:
        if window not in self.memo:
            self.memo[window] = _pieces(window)
        return self.memo[window]

    def odds(self, window: str) -> list[float]:
        """Of each piece. One that makes documents abusive has abusive labels but for NOISE; else as many as all documents."""
        yes, no = math.log((1 - NOISE) / self.share), math.log(NOISE / (1 - self.share))
        return [self.yes[p] * yes + self.no[p] * no for p in self.pieces(window)]

    def split(self, window: str, least: float) -> tuple[str, str]:
        """The abusive and the ordinary part of a window; there is an abusive one if its three strongest pieces reach ``least`` on average."""
        odds = self.odds(window)
        top = sorted(set(zip(odds, self.pieces(window))), reverse=True)[:3]
        if sum(x for x, _ in top) <= least * len(top):
            return "", window
        units = _UNIT.findall(window)
        marked = [any(x > 0 for x in odds[max(0, i - 2) : i + 1]) for i in range(len(units))]
        part = lambda y: _CJK_GAP.sub("", " ".join(u for u, m in zip(units, marked) if m == y))
        return part(True), part(False)


def _fit(documents: list[tuple[list[str], bool]], least: float, memo: dict[str, list[str]]) -> CompressionModel:
    evidence = _Evidence(documents, memo)
    abusive, ordinary = Counter(), Counter()
    held = Counter(w for windows, _ in documents for w in dict.fromkeys(windows))  # in how many documents; in their order, so that ties are settled alike in every run
    for w, n in held.items():
        for part, to in zip(evidence.split(w, least), (abusive, ordinary)):
            if part:
                to[part] += n
    for seed, to in ((ABUSIVE_SEED, abusive), (ORDINARY_SEED, ordinary)):
        to.update(_seed(seed))
    words: dict[int, Counter] = {}
    for w in abusive:
        for word in _UNIT.findall(w):
            if word.isalpha() and "*" not in word:
                words.setdefault(len(word), Counter())[word] += abusive[w]
    rare = {n: [w for w, _ in c.most_common()] for n, c in words.items()}
    return CompressionModel(train_dictionary(abusive), train_dictionary(ordinary), rare)


def fit(reviewed: list[tuple[int, str, float]]) -> CompressionModel:
    """reviewed: doc_id, text, mean label. Evidence and threshold are those of the best F1 on documents that the dictionaries had not seen."""
    documents = [(plain_windows(t), y > 0.5) for _, t, y in reviewed if y != 0.5]
    options, memo = [], {}
    if sum(y for _, y in documents) >= FOLDS:
        for least in EVIDENCE:
            scored = []
            for f in range(FOLDS):
                model = _fit([x for i, x in enumerate(documents) if i % FOLDS != f], least, memo)
                found: dict[str, float] = {}
                for w in {w for windows, _ in documents[f::FOLDS] for w in windows}:
                    found[w] = model.distance(w)
                scored += [(max(map(found.__getitem__, w), default=-1.0), y) for w, y in documents[f::FOLDS]]
            options.append((*best_threshold(scored), least))
    f1, threshold, least = max(options, default=(0.0, 0.1, EVIDENCE[-1]))
    model = _fit(documents, least, memo)
    model.threshold = threshold
    return model


def best_threshold(scored: list[tuple[float, bool]], least: float = 0.02) -> tuple[float, float]:
    """Best F1 and the threshold that gives it."""
    scored = sorted(scored, reverse=True)
    total, hits, best, at = sum(y for _, y in scored), 0, 0.0, 0.1
    for i, (s, y) in enumerate(scored):
        hits += y
        following = scored[i + 1][0] if i + 1 < len(scored) else -1.0
        if s != following and s > least and (f1 := 2 * hits / (i + 1 + total)) > best:
            best, at = f1, (s + max(following, least)) / 2
    return best, at


def reviewed_documents(docs: DataFrame, labels: DataFrame, most: int = MAX_REVIEWED, chars: int = 100_000) -> list[tuple[int, str, float]]:
    """(doc_id, text, mean label) of at most ``most`` reviewed documents of up to ``chars`` characters each and TRAINING_CHARS together, for training only."""
    judged = labels.where("doc_id is not null and abusive is not null").groupBy("doc_id").agg(F.avg("abusive").alias("label"))
    rows = docs.where(F.length("text") <= chars).select("doc_id", "text").join(judged, "doc_id")
    order = [F.xxhash64("doc_id"), "doc_id", "text"]
    few = rows.orderBy(*order).limit(most)
    so_far = F.sum(F.length("text")).over(Window.orderBy(*order))  # of MAX_REVIEWED rows
    return [tuple(r) for r in few.withColumn("_chars", so_far).where(F.col("_chars") <= TRAINING_CHARS).drop("_chars").orderBy(*order).collect()]


#: The last models fitted in this process, by a hash of what they were fitted on.
_FITTED: dict[str, CompressionModel] = {}


def fitted(reviewed: list[tuple[int, str, float]]) -> CompressionModel:
    """fit, once for the same reviewed documents."""
    key = hashlib.sha256(repr(reviewed).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _FITTED:
        if len(_FITTED) >= 4:
            _FITTED.clear()
        _FITTED[key] = fit(reviewed)
    return _FITTED[key]


def score_documents(docs: DataFrame, model: CompressionModel, text: str = "text") -> DataFrame:
    """docs without its text column, with score (double) and abusive (boolean), in place of columns of these names.

    Every window of every text is scored. Null, empty and blank texts have the score -1.
    """
    threshold = model.threshold
    parts = (model.abusive, model.ordinary, model.words, threshold)  # two dictionaries of DICTIONARY_BYTES at most
    shared = docs.sparkSession.sparkContext.broadcast(parts)
    keep = [f for f in docs.schema if f.name not in (text, "score", "abusive")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = CompressionModel(*shared.value).remembering()
        for batch in batches:
            scores = [score(t) for t in batch.column(0).to_pylist()]
            made = [pa.array(scores, pa.float64()), pa.array([s > threshold for s in scores], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*batch.schema.names[1:], "score", "abusive"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keep] + [T.StructField("score", T.DoubleType()), T.StructField("abusive", T.BooleanType())])
    return docs.select(text, *[f.name for f in keep]).mapInArrow(run, schema)


def _scored(spark, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fitted(reviewed_documents(docs, spark.read.parquet(f"{d}/review_labels.parquet")))
    return score_documents(docs.select("doc_id", "source", "text"), model)


def p9_found(spark, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id").distinct()


def p9_scores(spark, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "score", "abusive")


def p9_rates(spark, d: str) -> DataFrame:
    """Rates per source, null being a source of its own."""
    rows = _scored(spark, d).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("abusive").cast("long")).alias("n_abusive"))
    return rows.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))


def p9_documents(spark, d: str) -> DataFrame:
    """How many documents of each source were scored."""
    return _scored(spark, d).groupBy("source").agg(F.count("score").alias("n_documents"))


QUERIES = {f.__name__: f for f in (p9_found, p9_scores, p9_rates, p9_documents)}
