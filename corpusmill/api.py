"""One entry point over stored tables: the operations a service would expose, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import pii, text
from .operators import catalog, evaluate, filters, guardrails, profile, quality, telemetry
from .plans import aggregate, answer, ingest
from .sources import files, sinks
from .streaming.intake import stored

TABLES = ("documents", "chunks", "traces", "feedback", "audit", "failed")
# Draft styles.
DRAFT_STYLES = ("공문서_개조식", "보고서_서술형", "요약표")


class Corpus:
    """Documents, chunks, traces, feedback and audit rows below one folder."""

    def __init__(self, spark: SparkSession, store: str, settings: Settings | None = None, dim: int | None = None):
        self.spark, self.store = spark, store
        self.settings = settings or Settings()
        self.dim = dim or self.settings.embedding_dim

    def table(self, name: str) -> DataFrame:
        found = stored(self.spark, self.store, name)
        if found is None:
            raise LookupError(f"nothing stored in {name} yet")
        return found

    def _append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.store}/{name}")

    # Documents.
    def ingest(self, documents: DataFrame) -> DataFrame:
        """Store new documents (document_id, source_name, project_name, text) and their chunks."""
        fresh, _chunks = ingest.ingest(documents, self.settings, self.dim, stored(self.spark, self.store, "documents"))
        run = fresh.sparkSession.sparkContext.applicationId + "-" + str(self.spark.sparkContext._jvm.System.nanoTime())
        target = f"{self.store}/documents/run={run}"
        fresh.write.parquet(target)
        written = self.spark.read.parquet(target)
        ingest.to_chunks(written, self.settings, self.dim).write.parquet(f"{self.store}/chunks/run={run}")
        return written

    def ingest_files(self, path: str, project: str = "default") -> DataFrame:
        """Stores the files below ``path``; those that cannot be read go to the table ``failed`` with their error."""
        everything = files.parse_documents(files.read_files(self.spark, path))
        self._append(everything.where(F.col("parsed.error").isNotNull()).select(
            F.col("name").alias("source_name"), F.col("parsed.error").alias("error"), F.sha2("payload", 256).alias("content_hash"),
            F.current_timestamp().alias("created_at")), "failed")
        parsed = everything.where(F.col("parsed.error").isNull())
        return self.ingest(parsed.select(
            F.sha2(F.concat_ws("\x01", "name", F.sha2("payload", 256)), 256).alias("document_id"), F.col("name").alias("source_name"),
            F.lit(project).alias("project_name"), F.col("parsed.text").alias("text")))

    def list_documents(self, pattern: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        docs = self.table("documents")
        docs = filters.search_documents(docs, pattern) if pattern else docs
        rows = catalog.chunk_counts(docs.drop("content"), self.table("chunks"))
        return filters.page(rows, [F.asc("source_name"), F.asc("document_id")], limit, offset)

    def document_chunks(self, document_id) -> DataFrame:
        return self.table("chunks").where(F.col("document_id") == document_id).orderBy("chunk_index")

    def without(self, ids: DataFrame, project: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Both tables after a deletion, for the caller to write to a new place."""
        return catalog.delete_documents(self.table("documents"), self.table("chunks"), ids, project)

    def stats(self) -> DataFrame:
        return catalog.statistics(self.table("documents"), self.table("chunks"))

    # Questions.
    def query(self, questions: DataFrame, mode: str = "dense", scope: filters.SearchScope | None = None, **models) -> answer.Answered:
        from .functions.vectors import hash_embedding

        models.setdefault("embed", lambda column: hash_embedding(column, self.dim))
        return answer.answer_questions(questions, self.table("chunks"), self.table("documents"), self.settings, mode, scope, **models)

    def query_events(self, answered: answer.Answered) -> DataFrame:
        return answer.events(answered)

    def query_table(self, df: DataFrame, question: str, planner=None) -> aggregate.AggregateAnswer:
        return aggregate.answer_question(df, question, planner)

    def query_stored_table(self, document_id, question: str, table_index: int = 0, planner=None) -> aggregate.AggregateAnswer:
        """Aggregate one Markdown table of a stored document."""
        docs = self.table("documents").where(F.col("document_id") == document_id)
        rows = files.markdown_tables(docs, "document_id", "content").where(F.col("table_index") == table_index)
        header = rows.where("row_index = 0").select("cells").first()
        if header is None:
            raise ValueError("no such table in the document")
        files.check_header(header["cells"])
        body = rows.where("row_index > 0").select(*[F.col("cells")[i].alias(c) for i, c in enumerate(header["cells"])])
        return self.query_table(body, question, planner)

    def draft(self, titles: DataFrame, style: str, complete) -> answer.Answered:
        """Drafts (query_id, query_text as title) written by ``complete(title, context, style)``."""
        if style not in DRAFT_STYLES:
            raise ValueError("unknown draft style")
        return self.query(titles, "weighted", complete=lambda title, context: complete(title, context, F.lit(style)))

    def extract(self, df: DataFrame, answer_column: str, schema: str) -> DataFrame:
        """Fields of an extraction schema read from model answers in ``answer_column``."""
        body = text.first_json_object(answer_column)
        return df.withColumn("extracted", files.schema_fields(body, files.EXTRACTION_SCHEMAS[schema]))

    # Quality, guardrails, evaluation.
    diagnose = staticmethod(quality.text_quality)
    enterprise = staticmethod(quality.enterprise_quality)
    structured = staticmethod(profile.evaluate_dataset)
    validate_input = staticmethod(guardrails.input_guardrail)
    validate_output = staticmethod(guardrails.output_guardrail)
    evaluate = staticmethod(evaluate.score_answers)
    mask = staticmethod(pii.mask_pii)

    # Traces and feedback.
    def record(self, answered: answer.Answered, latency_ms: float = 0.0) -> None:
        """Stores traces and audit rows; ``latency_ms`` is what the caller measured for the batch."""
        rows = answer.traces(answered).withColumn("total_latency_ms", F.lit(float(latency_ms)))
        self._append(rows, "traces")
        self._append(answered.answers.select(
            F.col("audit_query").alias("query"), "hit_count", "confidence_score", "hallucination_risk", F.current_timestamp().alias("created_at")), "audit")

    def add_feedback(self, feedback: DataFrame) -> None:
        self._append(feedback.select("trace_id", "thumbs", "rating", "corrected_answer"), "feedback")

    def recent_traces(self, limit: int = 50, action: str | None = None) -> DataFrame:
        return telemetry.recent(self.table("traces"), limit, "id", action)

    def audit_logs(self, limit: int = 50) -> DataFrame:
        logs = self.table("audit").withColumn("query", filters.redact_query("query"))
        return logs.orderBy(F.desc("created_at"), F.asc("query")).limit(limit)

    def metrics(self) -> DataFrame:
        return telemetry.metrics_summary(self.table("traces"), self.table("feedback"))

    def export_curated(self, path: str, min_rating: int = 4) -> None:
        sinks.export_curated(telemetry.curated_samples(self.table("traces"), self.table("feedback"), min_rating), path)
