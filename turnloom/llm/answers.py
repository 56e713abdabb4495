"""Operator: answers that do not properly answer, with their type of defect."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.languages import LanguageModel, fit
from turnloom.plans.lineage import cut

#: Labelled rows the language model is fitted on at most.
SAMPLE = 15_000
#: Log odds by which another language must lead the question's.
LANGUAGE_MARGIN = 14.0
#: Words from which an unended text is judged at all, and from which its last words alone are compared.
SOME_WORDS, LONG_WORDS = 5, 9
#: Words of a run.
RUN = 3
# Reasons that name the output limit, texts that only hold a place.
LIMIT_REASONS = ["length", "max_tokens", "max_length", "max_output_tokens", "token_limit", "model_length", "truncated"]
PLACEHOLDERS = ["none", "null", "nil", "nan", "na", "n a", "undefined", "unknown", "tbd", "todo", "empty", "answer", "no answer", "placeholder", "blank", "nothing", "answer answer"]

# Ways to decline in the six languages, matched within one sentence.
_REFUSALS = [
    r"\b(i|we)('m| am)? ?(can ?not|can't|can not|won't|will not|am unable|am not able|must decline|have to decline|must refuse|refuse|decline)\b.{0,40}\b(help|assist|answer|share|discuss|respond|provide|comply|disclose|talk|reveal|be able)",
    r"\bas an? (ai|language) .{0,20}\b(can ?not|can't|unable|not able|must|won't)\b", r"\bi must decline\b", r"\bi('d| would) rather not\b",
    r"outside what i am (permitted|allowed)", r"\bwould violate the privacy\b", r"not a question an assistant should", r"let's talk about something else",
    r"\bagainst my (guidelines|rules|polic)", r"(isn't|is not) something i('m| am) (comfortable|allowed|able|willing)", r"^\W*no comment\b",
    r"\bkann ich (dabei |dir |ihnen )?(leider )?nicht (helfen|beantworten|weiterhelfen)", r"dabei kann ich nicht helfen", r"gegen meine (richtlinien|regeln)", r"gebe ich keine auskunft", r"\bmöchte ich (leider )?nicht (geben|beantworten|sagen)",
    r"nicht befugt", r"\bdarf ich .{0,40}nicht (beantworten|sagen|geben|besprechen)", r"beantwortung .{0,30}(ablehnen|verweigern)", r"\bich (muss|möchte|kann|darf) .{0,60}(ablehnen|verweigern)",
    r"\bno puedo (ayudar|responder|contestar|compartir|dar)", r"en contra de mis (normas|reglas|directrices)", r"\bdebo negarme\b", r"no me está permitido", r"prefiero no (contestar|responder|dar|compartir|hablar)",
    r"\bje ne peux pas (aider|répondre|vous|t’|partager|traiter|donner)", r"contraire à mes (règles|principes|consignes)", r"je préfère ne pas", r"m[’']est impossible de (traiter|répondre|donner|aider)", r"je n[’']ai pas le droit de", r"je (dois|refuse) (refuser|de répondre|décliner)", r"je dois (décliner|refuser)",
    r"não (posso|consigo) (ajudar|responder|partilhar|compartilhar|dar|fornecer)", r"contra as minhas (regras|diretrizes|normas)", r"prefiro não (fornecer|responder|dar|partilhar|compartilhar|falar)", r"não tenho permissão", r"(devo|tenho de|preciso) (recusar|me recusar|recusar-me)", r"recuso-me",
    r"я не могу (помочь|ответить|отвечать|обсуждать|делиться)", r"вынужден[аы]? отказаться", r"мне нельзя", r"мне не разрешено", r"противоречит моим", r"я (предпочитаю|предпочту|предпочёл бы) не", r"отказываюсь (отвечать|от ответа)", r"не (стану|буду) (отвечать|обсуждать|раскрывать)", r"не вправе (отвечать|обсуждать|разглашать)",
]
REFUSAL = re.compile("|".join(f"(?:{p})" for p in _REFUSALS), re.I)
#: One of these stands in every text that ``REFUSAL`` matches.
_TELLING = [
    "can't", "can not", "cannot", "won't", "will not", "unable", "not able", "decline", "refuse", "ai ", "language ", "rather not", "permitted", "allowed", "privacy", "should", "something else", "against my", "comfortable", "willing", "no comment",
    "helfen", "gegen meine", "auskunft", "möchte ich", "befugt", "darf ich", "ablehnen", "verweigern", "kann ich", "no puedo", "en contra de mis", "negarme", "permitido", "prefiero no",
    "peux pas", "contraire à", "préfère ne", "impossible", "le droit", "je dois", "je refuse", "não posso", "não consigo", "contra as minhas", "prefiro não", "não tenho permissão", "recus",
    "не могу", "отказ", "нельзя", "не разрешено", "противоречит", "я пред", "не стану", "не буду", "не вправе",
]
_SENTENCE = re.compile(r"(?<=[.!?])[\"”»’]*\s+")
_PLAIN = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?。؟…]+(?!\d)")
_TRAILING = " \t\r\n.…\"”»"
_ENDED = r"[.!?。؟][\s\p{Z}\p{C}\"”»’')\]*_`]*$"


def plain(text: str | None) -> str:
    """Lower-case letters and digits with single blanks between words."""
    return _PLAIN.sub(" ", text.lower()).strip() if text else ""


def copies_question(prediction: str, question: str) -> bool:
    """Whether a text holds the question, once or more, and nothing else but a short lead-in before it."""
    q = plain(question)
    if not q or q.rsplit(" ", 1)[-1] not in prediction.lower():
        return False
    p = plain(prediction)
    if q not in p:
        return False
    before, _, after = f" {p} ".partition(f" {q} ")
    if not after.replace(q, " ").strip() and not before.strip():
        return True
    lead = before.strip()
    return not after.replace(q, " ").strip() and len(lead.split()) <= 6 and any(s in prediction for s in ":—–-\n«“\"")


def declines(prediction: str) -> bool:
    """Whether one of the text's sentences declines to answer."""
    low = prediction.lower()
    if not any(k in low for k in _TELLING):
        return False
    parts = [s for s in _SENTENCE.split(prediction.strip()) if s.strip()]
    return any(REFUSAL.search(s) for s in parts)


def is_empty(text: Column) -> Column:
    """Null, nothing readable, or only a placeholder, in or out of tags."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"<[^<>]*>", " "), r"[^\p{L}\p{N}]+", " "))
    hold = (bare == "") | bare.isin(PLACEHOLDERS)
    # Without a tag a text of 20 letters and digits is none of these.
    plainly = ~text.contains("<") & text.rlike(r"(?:[\p{L}\p{N}][^\p{L}\p{N}]*+){20}")
    return F.coalesce(F.when(plainly, False).otherwise(hold), F.lit(True))


def hit_limit(reason: Column) -> Column:
    """Whether a finish reason names the output limit."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(reason)), r"[\s-]+", "_").isin(LIMIT_REASONS), F.lit(False))


def unended(text: Column) -> Column:
    """Whether a text stops without closing punctuation, or with dots that trail off."""
    end = F.right(text, F.lit(24))
    shown = F.when(end.rlike(r"[^\s\p{Z}\p{C}\"”»’')\]*_`.…]"), end).otherwise(text)  # the end tells unless it is all closing marks
    return ~shown.rlike(_ENDED) | shown.rlike(r"[^.…\s](…|\.\.\.)[\s\"”»]*$")


def has_words(text: Column, n: int) -> Column:
    """Whether a text has ``n`` words or more."""
    return text.rlike(r"(?:[\p{L}\p{N}]++[^\p{L}\p{N}]*+){%d}" % n)


def continued_texts(texts: DataFrame, more: int) -> DataFrame:
    """Of distinct ``text`` with flag ``open``, the open ones that another text begins with and continues by ``more`` words (0: by any sign).

    In sort order the texts that one text begins stand directly behind it, so a walk keeps only the open
    texts that begin the one at hand.  What is still open at the end of a range meets the start of the ranges
    behind it; of a range's start one text for each length in common with its first is enough.
    """

    def goes_on(text: str, by: str) -> bool:
        return len(by) > len(text) and by.startswith(text) and len(_WORD.findall(by[len(text) :])) >= more

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where any sign will do, the next text tells: only open texts and what stands behind them are looked at."""
        last, part = None, None
        for b in batches:
            texts, is_open, out = b["text"].to_numpy(object), b["open"].to_numpy(bool), []
            if not len(texts):
                continue
            if part is None:
                part = b["pid"].iat[0]
                out.append((texts[0], part, 2))
            if last is not None and texts[0].startswith(last):
                out.append((last, part, 0))
            out += [(texts[i], part, 0) for i in np.flatnonzero(is_open[:-1]) if texts[i + 1].startswith(texts[i])]
            last = texts[-1] if is_open[-1] else None
            yield pd.DataFrame(out, columns=["text", "pid", "kind"])
        if last is not None:
            yield pd.DataFrame([(last, part, 1)], columns=["text", "pid", "kind"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, part, head, heads = [], None, None, {}
        for b in batches:
            out = []
            for text, is_open, part in zip(b["text"], b["open"], b["pid"]):
                if head is None:
                    head, common = text, len(text)
                if common:
                    common = next((k for k in range(min(common, len(text))) if text[k] != head[k]), min(common, len(text)))
                    if common and len(text.split()) > len(heads.get(common, "").split()):
                        heads[common] = text
                while stack and not text.startswith(stack[-1]):
                    stack.pop()
                out += [(t, part, 0) for t in stack if goes_on(t, text)]
                stack = [t for t in stack if not goes_on(t, text)]
                if is_open:
                    stack.append(text)
            yield pd.DataFrame(out, columns=["text", "pid", "kind"])
        yield pd.DataFrame([(t, part, 1) for t in stack] + [(t, part, 2) for t in {head, *heads.values()} - {None}], columns=["text", "pid", "kind"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(n, "text").sortWithinPartitions("text").withColumn("pid", F.spark_partition_id())
    rows = cut(ordered.mapInPandas(walk if more else step, "text string, pid int, kind int"))
    # What meets at the borders: texts of one chain of prefixes, and a text for each length of a first text, from each range.
    border = rows.where("kind > 0").toPandas()
    heads = border[border["kind"] == 2].sort_values(["pid", "text"])
    late = [t for t, pid in border.loc[border["kind"] == 1, ["text", "pid"]].itertuples(index=False) if any(goes_on(t, h) for h in heads.loc[heads["pid"] > pid, "text"])]
    found = rows.where("kind = 0").select("text")
    return (found.unionByName(texts.sparkSession.createDataFrame([(t,) for t in late], "text string")) if late else found).distinct()


def _tail(text: str) -> list[str]:
    """Words of the sentence a text stops in."""
    return _STOP.split(text.rstrip(_TRAILING))[-1].split()


def runs(texts: DataFrame) -> DataFrame:
    """(text, open, closed) of runs of up to ``RUN`` words within the sentences of ``text``: closed where a sentence ends with the run, open where an unended text of ``LONG_WORDS`` stops after it."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["text", "open", "closed"]
        for b in batches:
            plain_runs, closed, tails = set(), set(), set()
            for text, is_open in zip(b["text"], b["open"]):
                pieces = _STOP.split(text)
                for k, piece in enumerate(pieces):
                    words = piece.split()
                    plain_runs.update(" ".join(words[i : i + RUN]) for i in range(len(words)))
                    if k < len(pieces) - 1 and words:
                        closed.add(words[-1])
                if is_open:
                    words = _tail(text)
                    tails.update(" ".join(words[-k:]) for k in (1, 2) if len(words) >= k)
            yield pd.DataFrame([(r, r in tails, r in closed) for r in plain_runs | tails | closed], columns=names)

    got = texts.mapInPandas(split, "text string, open boolean, closed boolean")
    return got.groupBy("text").agg(F.max("open").alias("open"), F.max("closed").alias("closed"))


def broken_off(texts: DataFrame) -> DataFrame:
    """Of distinct ``text`` with flags ``open`` and ``long``, those that the sorted neighbours show to be shortened.

    Either another text begins with the whole of it and goes on by two words; or it is long and its last two
    words, the last perhaps cut, begin a longer run in some text; or its last word does, and no sentence
    anywhere ends with that word.
    """
    whole = continued_texts(texts.select("text", "open"), 2)
    every = cut(runs(texts.select("text", F.col("long").alias("open"))))
    on = continued_texts(every.select("text", "open"), 0).join(every.select("text", "closed"), "text").withColumnRenamed("text", "run")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [_tail(t) for t in b["text"]]
            yield pd.DataFrame({"text": b["text"], "runs": [[" ".join(w[-k:]) for k in (1, 2) if len(w) >= k] for w in words]})

    tails = texts.where("long").select("text").mapInPandas(ends, "text string, runs array<string>").select("text", F.posexplode("runs").alias("k", "run"))
    return whole.unionByName(tails.join(on, "run").where("k = 1 or not closed").select("text")).distinct()


def limit_spikes(rows: DataFrame) -> DataFrame:
    """(model, completion_tokens) at which open texts pile up: three times the mean of the counts within 4 tokens, and 3 rows at least."""
    counts = rows.where("completion_tokens is not null and open").groupBy("model", "completion_tokens").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("model").orderBy("completion_tokens").rangeBetween(-4, 4)
    return counts.withColumn("around", (F.sum("n").over(w) - F.col("n")) / 8.0).where("n >= 3 and n >= 3 * around").select("model", "completion_tokens", F.lit(True).alias("spike"))


def language_model(answers: DataFrame, questions: DataFrame) -> LanguageModel:
    """Fitted on the ``SAMPLE`` answers of lowest hash (and their questions), labelled by the question's language."""
    pick = answers.where(F.length("prediction") > 20).select("question_id", "prediction", F.xxhash64("answer_no", F.lit(7)).alias("h")).orderBy("h").limit(SAMPLE)
    rows = pick.join(questions.where("lang is not null").select("question_id", "question", "lang"), "question_id").toPandas()
    texts = rows["prediction"].tolist() + rows["question"].fillna("").tolist()
    return fit(texts, rows["lang"].tolist() * 2) if len(rows) else fit([""], ["en"])


def defective_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(answer_no, defect) of each row with a defect; the first of empty, copies_question, refusal, truncated, wrong_language.

    An unended text is truncated where its sorted neighbours show it to be shortened (``broken_off``), where
    it stands on a spike of its model's lengths, or where the finish reason names the limit; no length decides.
    Repeated rows are judged one by one.  Answers without a question row keep the defects that need none.
    """
    model = language_model(answers, questions)
    a = answers.select("answer_no", "question_id", "prediction", "completion_tokens", hit_limit(F.col("finish_reason")).alias("limit"), F.lower(F.trim("answer_model")).alias("model"))
    empty = a.where(is_empty(F.col("prediction"))).select("answer_no", F.lit("empty").alias("defect"))
    read = a.where(~is_empty(F.col("prediction"))).withColumn("open", unended(F.col("prediction")) & has_words(F.col("prediction"), SOME_WORDS))
    texts = cut(read.groupBy(F.col("prediction").alias("text")).agg(F.max("open").alias("open")).withColumn("long", F.col("open") & has_words(F.col("text"), LONG_WORDS)))
    short = broken_off(texts).select(F.col("text").alias("prediction"), F.lit(True).alias("shortened"))
    opened = read.where("open").join(short, "prediction", "left").join(limit_spikes(read), ["model", "completion_tokens"], "left")
    evidence = F.coalesce("shortened", F.lit(False)) | F.coalesce("spike", F.lit(False))
    columns = ["answer_no", "question_id", "prediction", "limit"]
    judged = opened.select(*columns, evidence.alias("broken")).unionByName(read.where("not open").select(*columns, F.lit(False).alias("broken")))
    judged = judged.join(questions.select("question_id", "question", "lang"), "question_id", "left")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {x: k for k, x in enumerate(model.languages)}
        for b in batches:
            which, texts = pd.factorize(b["prediction"])
            scores, refused = model.scores(list(texts))[which], [declines(t) for t in texts]
            own = np.array([at.get(x, -1) for x in b["lang"]], "i8")
            lead = scores.max(1) - scores[np.arange(len(b)), np.maximum(own, 0)]
            out = []
            for no, text, q, limit, broken, foreign, k in zip(b["answer_no"], b["prediction"], b["question"], b["limit"], b["broken"], (own >= 0) & (lead > LANGUAGE_MARGIN), which):
                if isinstance(q, str) and copies_question(text, q):
                    out.append((no, "copies_question"))
                elif refused[k]:
                    out.append((no, "refusal"))
                elif limit or broken:
                    out.append((no, "truncated"))
                elif foreign:
                    out.append((no, "wrong_language"))
            yield pd.DataFrame(out, columns=["answer_no", "defect"])

    return empty.unionByName(judged.mapInPandas(judge, "answer_no bigint, defect string"))
