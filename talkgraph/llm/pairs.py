"""Defective prompt and response pairs: a conditional random field over the clauses of a response.

Each clause is tagged as answer, refusal, echo (of the question), foreign (another language than the
question's) or unfinished by a linear-chain CRF; the words that each tag covers decide the pair's defect. The
CRF is trained on the driver from a bounded sample of pairs (TRAIN_PAIRS), whose sound answers are also cut,
swapped for ones in other languages, for their questions and for refusals, so that every clause has a known
tag. Word statistics and the longest wording of each question's answers come from all pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Pairs that the CRF is trained on at most.
TRAIN_PAIRS = 2000
#: Share of a response's words that decides its defect.
COVER = 0.5
#: Words of a remark that a whole sentence of refusal may be followed by.
REMARK = 5
#: A word of small letters is taken for a piece of one that begins with it and is so many times as frequent.
PIECE = 4

# What stands for no value.
NO_VALUE = frozenset("na n/a none null nil nan nothing unknown tbd empty undefined keine aucun ninguno ninguna".split())
# Frequent words of the languages.
STOP = {
    "en": frozenset("the of and to in is that it with on was for are this which by from an be at as has have not its when does how what why while both over than".split()),
    "de": frozenset("der die das und ist nicht mit ein eine einen einer auf für den dem im um von zu auch wird wurde werden sich weil wenn welche nutzt als aus bei nur kürzere".split()),
    "fr": frozenset("le la les des du et est une un dans que qui pour sur pas avec au aux plus sont par il elle ce cette quelle quel utilise n’a n'a été".split()),
    "es": frozenset("el los las y es una un que con por del se no más para al como su fue qué cuál usa sus según también después todavía lo y".split()),
    "pt": frozenset("o os as e é uma um que com por do da dos das não mais para ao como seu foi qual são também após na no nos pela pelo mas à".split()),
    "ru": frozenset("и в не на что с по для как это из при от к но или мы его она был".split()),
    "it": frozenset("il gli e è una un che con per del della non più sono anche come di nel alla".split()),
}
# Frequent words of further languages, asked only where the first ones have too little.
MORE = {
    "nl": frozenset("de het een van en in is dat op te voor met niet zijn wordt door aan om ook naar bij uit maar nog dan deze wat over".split()),
    "pl": frozenset("i w na z do nie się jest że to przez dla od po jak oraz są przy ale ten który która może tylko za".split()),
    "sv": frozenset("och i att det som en på är av för med till den har inte om ett men kan från vid eller när också".split()),
    "da": frozenset("og i at det som en på er af for med til den har ikke om et men kan fra ved eller når også der".split()),
    "tr": frozenset("ve bir bu için ile da de olarak daha çok gibi en ne var olan ancak kadar sonra göre veya değil her".split()),
    "cs": frozenset("a v se na je že to s z do pro jako ale by po která který jsou není při nebo tak však".split()),
    "ro": frozenset("și în de la cu pe nu este o un din pentru care mai ce sunt prin dar ca se sau după".split()),
    "fi": frozenset("ja on ei että se oli hän mutta kun ovat myös joka tai kuin niin sekä vain ole siitä".split()),
    "hu": frozenset("a az és hogy nem is egy ez van de meg volt csak mint már vagy még ha mert azt".split()),
    "id": frozenset("yang dan di dari untuk dengan ini itu pada tidak adalah dalam akan ke oleh juga atau karena bahwa lebih".split()),
    "vi": frozenset("và của là có không một trong được cho các với này đã những để người khi như từ".split()),
}
# Scripts whose letters tell a language, or as much of it as matters.
_SCRIPTS = {"zh": "\u4e00-\u9fff", "ja": "\u3040-\u30ff", "ko": "\uac00-\ud7af", "el": "\u0370-\u03ff", "he": "\u0590-\u05ff", "ar": "\u0600-\u06ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f"}
_SCRIPT = re.compile("|".join(f"(?P<{c}>[{r}])" for c, r in _SCRIPTS.items()))
_LETTERS = {"de": "äöüß", "fr": "èêàçùœâîô", "es": "ñ¿¡ó", "pt": "ãõçâê", "ru": "абвгдежзиклмнопрстуфхцчшщыэюя", "it": "òì"}
# Words of refusals and of what they are about.
_CANNOT = re.compile(r"\b(?:can(?:no|'|’)?t|can not|could ?n[o'’]t|unable|not able|impossible|not possible|no way|will not|won['’]t|must decline|decline|do(?:es)? ?n[o'’]t|no answer|no information|no evidence|rather not|nowhere|not (?:mentioned|stated|provided|specified|available|given|covered|discussed)|(?:is|are|was|were)n['’]t (?:mentioned|stated|provided|specified|available|given|covered|discussed)|says nothing|nothing|nicht|kann|keine|ne peux|ne peut|impossible de|no puedo|no se puede|não posso|não é possível|не могу|невозможно)\b", re.I)
_SELF = re.compile(r"\b(?:i|i['’]m|me|my|as an? (?:ai|language|assistant)|model|ich|je|puedo|posso|я)\b", re.I)
_ABOUT = re.compile(r"\b(?:context|information|evidence|passages?|material|question|answer(?:ed)?|say|said|tell|know|determine|guess|provided|retrieved|given|available|sources?|subgraph|paper|slides?|talk|beantworten|frage|répondre|informations?|responder|información|informação|resposta)\b", re.I)
_SORRY = re.compile(r"\b(?:sorry|unfortunately|insufficient|not enough|don['’]t know|no idea|leider|désolé|lo siento|desculpe|apolog\w+|decline|language model|lamentablemente)\b", re.I)
# Words that a sentence doesn't end with.
_DANGLING = frozenset(
    "the a an of in on at to for with and or but that which who whose where when while than as by from such so because if into over between about under its their is are was were "
    "der die das ein eine und oder mit auf für von zu dass weil les des une dans avec pour sur que qui el los las una con para por del um uma dos das em os".split()
)
_FRAME = frozenset("question answer asks asked the is q a please respond here frage antwort réponse pregunta respuesta".split())
_WORD, _HUMP = re.compile(r"[^\W_]+"), re.compile(r"[a-zß-ÿ][A-Z]")
_CLAUSE = re.compile(r"(?<=[.!?;:])\s+|(?<=,)\s+(?=(?:but|yet|however|though|aber|mais|pero|mas)\b)", re.I)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def empty(text: str | None) -> bool:
    """Null, or nothing but white space, marks or a stand-in for no value."""
    return text is None or not _WORD.search(text) or re.sub(r"[^\w/]", "", text.lower()) in NO_VALUE


@lru_cache(maxsize=50_000)
def language(text: str) -> str:
    """The language whose script, or whose frequent words and letters, a text has most of; '' if there is too little to tell."""
    letters = sum(map(str.isalpha, text))
    signs = Counter(m.lastgroup for m in _SCRIPT.finditer(text))
    if signs and 2 * sum(signs.values()) > letters:
        return "ja" if signs["ja"] else max(signs, key=signs.get)
    own = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?", text) if not _HUMP.search(w)]
    hits = {c: sum(w in ws for w in own) for c, ws in STOP.items()}
    score = {c: hits[c] + 0.7 * sum(ch in _LETTERS.get(c, "") for ch in text.lower()) for c in STOP}
    score["pt"] += sum(w.endswith(("ção", "ções", "ão")) for w in own)
    score["es"] += sum(w.endswith(("ción", "ciones")) for w in own)
    best, second = sorted(score.values(), reverse=True)[:2]
    first = max(score, key=score.get)
    more = {c: sum(w in ws for w in own) for c, ws in MORE.items()}
    other = max(more, key=more.get)
    if more[other] >= 3 and more[other] >= 2 * max(hits.values()) and sorted(more.values())[-2] < more[other]:
        return other
    return first if best >= 2 and best > second else ""


def clauses(text: str) -> list[str]:
    return [c for c in _CLAUSE.split(text.strip()) if _WORD.search(c)]


def inside(core: str, longer: str | None) -> bool:
    """Whether a wording breaks off where a longer wording of the same answer goes on within its sentence."""
    if not longer or len(core) < 12 or core.count(" ") < 2:
        return False
    at = longer.find(core)
    if at < 0 or at + len(core) >= len(longer):
        return False
    begins = at == 0 or re.search(r"(?:[.,:;]|\b(?:but|yet))\s*$", longer[:at])
    rest = longer[at + len(core) :]
    opens = re.match(r"\s+([A-ZÀ-Þ][^\W_]*)\s", rest)  # a new sentence after a missing full stop
    return bool(begins) and not re.match(r"\s*[.!?]", rest) and not (opens and any(opens[1].lower() in ws for ws in STOP.values()))


def traits(question: str, response: str, known: float, ended: float, longer: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The clauses of a response and their features. known, ended: how often its last word stands inside a
    text or at the end of a sentence, over all pairs."""
    parts = clauses(response)
    asked, asked_in = set(words(question)), language(question)
    core = response.strip().rstrip(".!?…,;: ")
    rows = []
    for k, c in enumerate(parts):
        own = words(c)
        kept = [w for w in own if w not in _FRAME] or own
        share = sum(w in asked for w in kept) / len(kept)
        back = len(asked & set(own)) / max(1, len(asked))
        spoken = language(c)
        named = any(x.lower() in asked for x in _WORD.findall(c) if _HUMP.search(x) or x[0].isupper() and len(x) > 5)
        last = k == len(parts) - 1
        closed = bool(re.search(r"(?<![.…])[.!?][\"'”’»)*_\s]*$", c))
        cannot, sorry, about, self_ = (bool(x.search(c)) for x in (_CANNOT, _SORRY, _ABOUT, _SELF))
        tail = own[-1]
        sentence = len(own) >= 4 or len(parts) > 1
        broken = last and not closed and not tail.isdigit() and tail not in asked and known < 1
        rows.append([
            1.0, share >= 0.95, share >= 0.75, share < 0.5, back >= 0.95, back >= 0.7, share >= 0.95 and back >= 0.7,
            bool(spoken and asked_in and spoken != asked_in), bool(spoken and spoken == asked_in), not spoken,
            cannot and (about or self_) and not named, sorry, self_ and about, cannot, named, about and (cannot or sorry or self_),
            last and not closed and tail in _DANGLING and sentence, last and bool(re.search(r"[,;:–-]\s*$|\([^)]*$", c)), broken, broken and sentence,
            last and not closed and any(inside(core, x) for x in longer) and not any(x and core + "." in x for x in longer), last and bool(re.search(r"(?:\.\.|…)\s*$", c)), closed, last and not closed and ended < 1 and sentence, last and not closed, len(own) <= 4, k == 0, last,
        ])
    return parts, np.array(rows, float).reshape(len(parts), -1)


class CRF:
    """Linear chain: one weight per (feature, tag), (tag, next tag), first and last tag."""

    def __init__(self, n: int) -> None:
        k = len(TAGS)
        self.w, self.t, self.first, self.last = np.zeros((n, k)), np.zeros((k, k)), np.zeros(k), np.zeros(k)

    def params(self) -> tuple[np.ndarray, ...]:
        return self.w, self.t, self.first, self.last

    def fit(self, sequences: list[tuple[np.ndarray, list[int]]], rounds: int = 250, rate: float = 0.1, decay: float = 2e-3) -> CRF:
        """Maximum likelihood with weight decay by Adam; sequences of one length are handled together."""
        lots: dict[int, list[tuple[np.ndarray, list[int]]]] = {}
        for x, y in sequences:
            lots.setdefault(len(y), []).append((x, y))
        data = [(np.stack([x for x, _ in v]), np.array([y for _, y in v])) for v in lots.values()]
        total = len(sequences)
        mean, var = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()]
        for step in range(1, rounds + 1):
            grads = [-decay * p for p in self.params()]
            for x, y in data:
                for g, add in zip(grads, self._gradient(x, y)):
                    g += add / total
            for p, g, m, v in zip(self.params(), grads, mean, var):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        b, n, _ = x.shape
        k = len(TAGS)
        u = x @ self.w
        u[:, 0] += self.first
        u[:, -1] += self.last
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        fwd, bwd = np.zeros((b, n, k)), np.zeros((b, n, k))
        fwd[:, 0] = u[:, 0]
        for i in range(1, n):
            fwd[:, i] = u[:, i] + lse(fwd[:, i - 1][:, :, None] + self.t, 1)
        for i in range(n - 2, -1, -1):
            bwd[:, i] = lse(self.t + (u[:, i + 1] + bwd[:, i + 1])[:, None, :], 2)
        z = lse(fwd[:, -1], 1)
        prob = np.exp(fwd + bwd - z[:, None, None])
        gold = np.eye(k)[y]
        gt = np.zeros_like(self.t)
        for i in range(n - 1):
            joint = np.exp(fwd[:, i][:, :, None] + self.t + (u[:, i + 1] + bwd[:, i + 1])[:, None, :] - z[:, None, None])
            gt += (gold[:, i][:, :, None] * gold[:, i + 1][:, None, :] - joint).sum(0)
        diff = gold - prob
        return np.einsum("bnf,bnk->fk", x, diff), gt, diff[:, 0].sum(0), diff[:, -1].sum(0)

    def tag(self, x: np.ndarray) -> list[int]:
        """Viterbi."""
        u = x @ self.w
        u[0] += self.first
        u[-1] += self.last
        score, back = u[0], []
        for i in range(1, len(u)):
            step = score[:, None] + self.t
            back.append(step.argmax(0))
            score = step.max(0) + u[i]
        out = [int(score.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


# Our own wordings, which training sequences are made of.
_REFUSALS = (
    "I cannot answer this question.", "I'm unable to tell from the given context.", "Sorry, I don't have enough information to answer that.", "There is not enough information in the context.",
    "The paper does not say this, so I can't answer.", "Unfortunately I don't know the answer.", "As an assistant I am not able to see the slides; please ask the authors.", "No answer is possible with the material provided.",
    "The context says nothing about it.", "I do not know.", "Insufficient context.", "It is impossible to determine this from the retrieved text.", "I must decline, as no evidence was given.",
    "No information on this is available.", "That is not mentioned in the context.", "I would rather not guess.", "The question isn't covered by the material.",
    "Leider kann ich diese Frage nicht beantworten.", "Désolé, je ne peux pas répondre à cette question.", "Lo siento, no puedo responder a esta pregunta.", "Desculpe, não posso responder a esta pergunta.",
)
_CAVEATS = ("I can't give the precise words, but", "Unfortunately the slides say little, but", "I am not sure about the details, yet", "Sorry for the short reply, but", "I could not check the figure, however", "The paper doesn't go into detail here, but")
_LEADS = ("In brief,", "As the talk puts it,", "The paper answers this:", "According to the slides,", "Briefly put:")
_ECHOES = ("{q}", "“{q}”", "Question: {q} Answer:", "The question asks {q}", "{q} {q}", "You asked: {q}", "{l}", "  {q}\n")


def sequences(pairs: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Tagged training sequences from (question, sound answer)."""
    rng = np.random.default_rng(7)
    tongue = [language(q) for q, _ in pairs]
    tag = TAGS.index

    def seq(q: str, text: str, labels, known: float = 9, ended: float = 9, longer: str | None = None):
        parts, x = traits(q, text, known, ended, [longer])
        if parts:
            return x, [labels(i, len(parts)) for i in range(len(parts))]
        return None

    made = []
    for n, (q, a) in enumerate(pairs):
        whole = a if a.rstrip().endswith((".", "!", "?")) else a.rstrip() + "."
        made.append(seq(q, a, lambda i, m: tag("answer")))
        made.append(seq(q, whole.rstrip("."), lambda i, m: tag("answer"), 9, 0 if n % 3 == 0 else 9))
        if rng.random() < 0.3:
            made.append(seq(q, f"{_LEADS[n % len(_LEADS)]} {a}", lambda i, m: tag("answer")))
        if rng.random() < 0.4:
            caveat = _CAVEATS[n % len(_CAVEATS)]
            made.append(seq(q, caveat.replace(", ", ", ") + f" {a}", lambda i, m: tag("refusal") if i == 0 and m > 1 else tag("answer")))
        made.append(seq(q, _REFUSALS[n % len(_REFUSALS)], lambda i, m: tag("refusal")))
        e = _ECHOES[n % len(_ECHOES)].format(q=q, l=q.lower().rstrip("?") + ".")
        made.append(seq(q, e, lambda i, m: tag("echo")))
        for other in rng.integers(0, len(pairs), 6).tolist():
            if tongue[n] and tongue[other] and tongue[other] != tongue[n] and len(words(pairs[other][1])) > 5 and language(pairs[other][1]) == tongue[other]:
                made.append(seq(q, pairs[other][1], lambda i, m: tag("foreign")))
                break
        ws = a.split()
        if len(ws) >= 7:
            at = int(rng.integers(len(ws) // 2, len(ws)))
            kind, start = int(rng.integers(0, 4)), " ".join(ws[:at])
            if kind == 0 and len(ws[at - 1]) > 5:
                made.append(seq(q, start[:-2], lambda i, m: tag("unfinished") if i == m - 1 else tag("answer"), 0, 0, whole if n % 2 else None))
            elif kind == 1:
                made.append(seq(q, f"{start.rstrip('.,;')} {sorted(_DANGLING)[n % len(_DANGLING)]}", lambda i, m: tag("unfinished") if i == m - 1 else tag("answer"), 9, 0))
            elif kind == 2:
                made.append(seq(q, start.rstrip(".,;:") + ",;:"[n % 3], lambda i, m: tag("unfinished") if i == m - 1 else tag("answer"), 9, 0, whole if n % 2 else None))
            elif at < len(ws) and rng.random() < 0.8:
                made.append(seq(q, start.rstrip(".,;:"), lambda i, m: tag("unfinished") if i == m - 1 else tag("answer"), 9, 0 if n % 2 else 9, whole))
    yield from (m for m in made if m)


_models: dict[tuple, CRF] = {}


def model_of(rows: list[tuple[str | None, str | None]]) -> CRF:
    """The CRF of a sample, trained once in a driver."""
    if (key := tuple(rows)) not in _models:
        _models.clear()
        _models[key] = trained(rows)
    return _models[key]


def trained(rows: list[tuple[str | None, str | None]]) -> CRF:
    """A CRF from (question, reference answer) rows; unsound references are left out."""
    sound = []
    for q, a in rows:
        if q and not empty(a) and not _SORRY.search(a) and not (_CANNOT.search(a) and _SELF.search(a)):
            own, asked = words(a), set(words(q))
            if sum(w in asked for w in own) / len(own) < 0.7 and (len(own) < 6 or a.rstrip().endswith(".")) and language(a) in ("", language(q)):
                sound.append((q, a))
    base = sound or [("Which metric does the talk report for the model?", "The talk reports the error rate of the model on both data sets.")]
    n = traits(*base[0], 1, 1, [None])[1].shape[1]
    return CRF(n).fit(list(sequences(base)))


def defect(crf: CRF, question: str | None, response: str | None, known: float, ended: float, longer: list[str | None]) -> str | None:
    """The defect of one pair, null if there is none. A null question has no words and no language."""
    if empty(response):
        return "empty_answer"
    parts, x = traits(question or "", response, known, ended, longer)
    if not parts:
        return "empty_answer"
    tags = [TAGS[t] for t in crf.tag(x)]
    size = {t: 0 for t in TAGS}
    for t, c in zip(tags, parts):
        size[t] += len(words(c))
    total = sum(size.values())
    if size["refusal"] >= COVER * total > 0 and size["answer"] + size["unfinished"] < COVER * total:
        return "refusal"
    if any(t == "refusal" and re.search(r"[.!?]$", c.strip()) for t, c in zip(tags, parts)) and size["answer"] <= REMARK:
        return "refusal"
    if size["echo"] >= COVER * total and not size["answer"]:
        return "copies_question"
    if size["foreign"] > COVER * total:
        return "wrong_language"
    return "truncated" if tags[-1] == "unfinished" else None


def _last(c: Column) -> Column:
    return F.try_element_at(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.lit(-1))


def defects(results: DataFrame) -> DataFrame:
    """(result_id, answer_field, defect) of each defective pair of question and generated or reference answer.

    Where llm_evaluation.is_unanswerable is true, a refusal is right, and so is an empty reference. A null or
    empty answer is an empty one; a row repeated under one result_id is one row. Word counts and longest
    wordings are pre-aggregated; a question that a third of all rows ask is one row of either.
    """
    fields = F.array(*(F.struct(F.lit(c).alias("answer_field"), F.col(c).alias("answer"), F.col(o).alias("other")) for c, o in (("generated_answer", "ground_truth_answer"), ("ground_truth_answer", "generated_answer"))))
    rows = (
        results.dropDuplicates(["result_id"])
        .select("result_id", "sample_id", "question", F.coalesce("llm_evaluation.is_unanswerable", F.lit(False)).alias("open"), F.explode(fields).alias("f"))
        .select("result_id", "sample_id", "question", "open", "f.*").withColumn("last", _last(F.col("answer")))
    )
    texts = rows.select(F.col("answer").alias("t")).union(results.select("question")).where("t is not null")
    ended = F.col("t").rlike(r"[.!?…][\"'”’»)*_\s]*$")
    split = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counts = (
        texts.select(ended.alias("e"), split.alias("ws")).where(F.size("ws") > 0)
        .select("e", F.posexplode("ws").alias("p", "w"), F.size("ws").alias("n"))
        .groupBy(F.col("w").alias("last"))
        .agg(F.sum(((F.col("p") < F.col("n") - 1) | F.col("e")).cast("int")).alias("known"), F.sum(((F.col("p") == F.col("n") - 1) & F.col("e")).cast("int")).alias("ended"))
    )
    longest = rows.where("answer is not null").groupBy("sample_id").agg(F.max_by("answer", F.length("answer")).alias("longest"))
    # of a last word also how often a longer word that begins with it is known
    begun = counts.where(F.length("last") > 2).select(F.explode(F.transform(F.sequence(F.lit(2), F.length("last") - 1), lambda i: F.substring("last", F.lit(1), i))).alias("last"), "known")
    longer = begun.join(rows.select("last").distinct(), "last", "left_semi").groupBy("last").agg(F.max("known").alias("longer"))
    joined = rows.join(counts.join(longer, "last", "left"), "last", "left").join(longest, "sample_id", "left")
    sample = results.where("question is not null and ground_truth_answer is not null").select("question", "ground_truth_answer", F.xxhash64("result_id").alias("h")).orderBy("h").limit(TRAIN_PAIRS)
    sent = results.sparkSession.sparkContext.broadcast(model_of([(r[0], r[1]) for r in sample.collect()]))

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for part in parts:
            got = []
            for i, field, q, a, other, free, known, end, longest, begun in zip(*(part[c] for c in ("result_id", "answer_field", "question", "answer", "other", "open", "known", "ended", "longest", "longer"))):
                known, end, begun = (0 if pd.isna(x) else x for x in (known, end, begun))
                if known * PIECE < begun and a and re.search(r"(?<![^\W_])[^\W\d_A-Z]+\W*$", a):
                    known = 0
                d = defect(model, q, a, known, end, [other, longest])
                if d and not (free and (d == "refusal" or d == "empty_answer" and field == "ground_truth_answer")):
                    got.append((i, field, d))
            yield pd.DataFrame(got, columns=["result_id", "answer_field", "defect"])

    kind = dict(results.select("result_id").dtypes)["result_id"]
    return joined.select("result_id", "answer_field", "question", "answer", "other", "open", "known", "ended", "longest", "longer").mapInPandas(judge, f"result_id {kind}, answer_field string, defect string")
