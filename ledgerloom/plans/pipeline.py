"""Question to answer: a driver-side sequence of DataFrame steps over a batch of questions.

Models and live services are callables that take and give DataFrames; without them, rules and recorded payloads
answer. A question whose check fails is planned and retrieved again with its rewritten text, at most `retries`
times, and what was found before stays."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..operators import evidence as E
from ..operators import facts as Facts
from ..operators import recall as R
from ..operators import search as S
from ..session import written
from . import analyze as A
from . import route as P

#: question_id, source_name, content, citation, chunk_id, score: what a source gives for questions.
EVIDENCE = "question_id bigint, source_name string, content string, citation string, chunk_id string, score double"
Source = Callable[[DataFrame], DataFrame]


@dataclass
class Run:
    evidence: DataFrame
    context: DataFrame
    answers: DataFrame
    checks: DataFrame
    trace: list[dict] = field(default_factory=list)


def run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S_%f")


def gathered(questions: DataFrame, plan: DataFrame, sources: dict[str, Source], trace: list[dict], turn: int = 0) -> DataFrame:
    """All planned sources' evidence with `turn` and `source_order`. Each source's rows are written as it runs, so one
    that fails, at planning or at work, is recorded and left out, and none is computed twice."""
    spark, out = questions.sparkSession, None
    for nth, (name, source) in enumerate(sources.items()):
        asked = questions.join(plan.where(F.col("source_name") == name).select("question_id").distinct(), "question_id", "left_semi")
        began, n = time.perf_counter(), 0
        try:
            rows = source(asked).select("question_id", F.lit(name).alias("source_name"), "content", "citation", "chunk_id", "score").where(F.trim(F.coalesce("content", F.lit(""))) != "")
            rows = written(rows.select("*", F.lit(turn).alias("turn"), F.lit(nth).alias("source_order")), "evidence")
            n = rows.count()
            out = rows if out is None else out.unionByName(rows)
            status, why = "success", ""
        except Exception as error:  # noqa: BLE001  recorded: one source's failure isn't the others'
            status, why = "failed", str(error)[:200]
        trace.append({"step": f"source:{name}", "status": status, "failure": why, "evidence": n, "latency_ms": int(1000 * (time.perf_counter() - began))})
    return out if out is not None else spark.createDataFrame([], f"{EVIDENCE}, turn int, source_order int")


def answered(questions: DataFrame, plan: Callable[[DataFrame], DataFrame], sources: dict[str, Source], answer: Callable[[DataFrame], DataFrame], contracts: DataFrame, metrics: list[str], rewrite: Callable[[DataFrame], DataFrame] | None = None, retries: int = 1) -> Run:
    """`plan` gives (question_id, source_name); `answer` takes contexts and gives (question_id, answer); `contracts`
    has question_id, must_answer, numeric_check, citation_required."""
    trace: list[dict] = []
    found, open_ = None, questions
    for turn in range(retries + 1):
        began = time.perf_counter()
        new = gathered(open_, plan(open_), sources, trace, turn)
        found = new if found is None else found.unionByName(new)
        # The order in which it was found; inside a source by what the rows hold, the same on any run.
        numbered = found.withColumn("seq", F.struct("turn", "source_order", (-F.coalesce("score", F.lit(0.0))).alias("best"), "citation", "chunk_id", "content"))
        key = E.dedupe_key(F.col("source_name"), F.lit(""), F.lit(""), F.lit(""), F.col("citation"), F.col("chunk_id"), F.col("content"))
        selected = E.ledger(numbered, key, "score", "seq")
        context = E.context(selected)
        facts = Facts.first_facts(selected, metrics)
        said = answer(questions.join(context, "question_id", "left"))
        n = selected.groupBy("question_id").agg(F.count("*").alias("n_citations"))
        checks = E.verified(contracts.join(said, "question_id").join(n, "question_id", "left").fillna(0, ["n_citations"]), facts)
        trace.append({"step": f"turn:{turn}", "status": "success", "failure": "", "evidence": found.count(), "latency_ms": int(1000 * (time.perf_counter() - began))})
        if turn == retries or rewrite is None:
            break
        failed = checks.where("next_action = 'retrieve_more'").select("question_id")
        if failed.isEmpty():
            break
        open_ = rewrite(questions.join(failed, "question_id", "left_semi"))
    return Run(selected, context, said, checks, trace)


def branch(questions: DataFrame, intent: str = "intent") -> tuple[DataFrame, DataFrame]:
    """Questions that are answered directly, and those that go through retrieval."""
    chat = F.col(intent) == "chat"
    return questions.where(chat), questions.where(~chat)


def extractive(contexts: DataFrame) -> DataFrame:
    """The default answer where no model is plugged in: the start of the context."""
    return contexts.select("question_id", F.coalesce(F.substring("context_text", 1, 600), F.lit("")).alias("answer"))


def prompt(question, context, contract):
    """The text a plugged-in model would get."""
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), F.concat(F.lit("Must answer: "), F.array_join(contract, ", ")), F.lit("Answer from the numbered context alone and cite its numbers."), context)


def chat_prompt(question, history):
    """The text for a question that goes to no source."""
    return F.concat_ws("\n\n", F.lit("Answer the question directly, without citing sources."), F.nullif(F.coalesce(history, F.lit("")), F.lit("")), F.concat(F.lit("Question: "), question))


PARTS = ("evidence", "context", "answers", "checks")


def saved(run: Run, path: str, name: str, enabled: bool = True) -> list[str]:
    """A run's tables, its trace, and its contexts and answers as text, a folder each under the run's name; nothing where
    saving is off. The folders that were written."""
    if not enabled:
        return []
    spark = run.answers.sparkSession
    trace = spark.createDataFrame([tuple(t[k] for k in ("step", "status", "failure", "evidence", "latency_ms")) for t in run.trace], "step string, status string, failure string, evidence long, latency_ms long")
    for part in PARTS:
        getattr(run, part).write.mode("overwrite").json(f"{path}/{name}/{part}")
    trace.coalesce(1).write.mode("overwrite").json(f"{path}/{name}/trace")
    counts = spark.createDataFrame([(name, len(run.trace))], "run_id string, steps long").crossJoin(run.evidence.agg(F.count("*").alias("evidence"), F.countDistinct("question_id").alias("questions")))
    counts.write.mode("overwrite").json(f"{path}/{name}/summary")
    for part, table, body in (("context_md", run.context, "context_text"), ("answer_md", run.answers, "answer")):
        table.select(F.concat(F.lit("# "), F.col("question_id").cast("string"), F.lit("\n\n"), F.coalesce(body, F.lit("")))).write.mode("overwrite").text(f"{path}/{name}/{part}")
    return [*PARTS, "trace", "summary", "context_md", "answer_md"]


def filings_source(chunks: DataFrame, vectors: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, limit: int = 8, config: SearchConfig = SearchConfig()) -> Source:
    """Filings for questions: chunks of documents recalled by each question's code, else company, year and period, and
    for questions without any, hybrid search if there are vectors and a function that adds `vector` to questions.

    What a question names is read from it (`analyze.lexical`); a column of that name that it brings along goes first."""
    def run(asked: DataFrame) -> DataFrame:
        read = A.lexical(asked.select("question_id", "question")).select("question_id", *(F.col(c).alias(f"__{c}") for c in ("code", "year", "period")))
        given = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in asked.columns else F.lit(None).cast("string")
        named = asked.join(read, "question_id").select("question_id", *(F.coalesce(given(c), F.col(f"__{c}").cast("string"), F.lit("")).alias(c) for c in ("code", "period")), F.coalesce(given("year").cast("int"), F.nullif(F.col("__year").cast("string"), F.lit("")).cast("int"), F.lit(0)).alias("year"), F.coalesce(given("company"), F.lit("")).alias("company"))
        docs = R.recall_each(chunks, named, ["publish_date"], limit)
        subs = asked.select("question_id", "question", F.lit("main").alias("focus"))
        body = chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("content"), F.col("source_pdf").alias("citation"))
        staged = R.multistage(chunks, docs, subs, search_config=config).select("question_id", F.col("chunk_id").alias("id"), "score")
        if vectors is not None and embed is not None:
            rest = embed(asked.join(staged.select("question_id").distinct(), "question_id", "left_anti"))
            staged = staged.unionByName(S.hybrid(chunks, vectors, rest, config).select("question_id", "id", F.col("final").alias("score")))
        return staged.join(body, "id").select("question_id", "content", "citation", F.col("id").cast("string").alias("chunk_id"), "score")

    return run


def market_source(payloads: DataFrame, symbol: str = "symbol") -> Source:
    """Market data for questions with a symbol column, from recorded payloads (tool, symbol, payload): the routed tool's,
    or the first of its fallbacks that has one."""
    def run(asked: DataFrame) -> DataFrame:
        routed = asked.select("question_id", P.route(F.col("question"), F.col(symbol)).alias("route"))
        got = P.first_payload(P.calls(routed), payloads)
        text = F.concat_ws("\n", F.concat_ws(" ", "tool", "symbol"), F.nullif(P.headline(P.valuation(F.col("payload"))), F.lit("")), F.col("payload"))
        return got.select("question_id", text.alias("content"), F.concat_ws("/", "tool", "symbol").alias("citation"), F.lit("").alias("chunk_id"), F.lit(0.85).alias("score"))

    return run
