"""What a service in front of the engine answers: plain functions from requests to answers; a web framework is not part of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from assayloom.operators.article import agent_task
from assayloom.operators.chunk import chunk_articles


class RequestError(ValueError):
    """A request that can't be answered, with its HTTP status."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def health() -> dict:
    return {"status": "ok"}


def _article(spark: SparkSession, text: str):
    return spark.createDataFrame([("request", text)], "article_id string, text string")


def _cut(body: dict) -> dict:
    return {"targets": body.get("target_sections"), "max_chars": int(body.get("max_chars", 6000)), "overlap": int(body.get("overlap_chars", 400))}


def chunk_text(spark: SparkSession, body: dict) -> dict:
    """The chunks of a text, in order."""
    if not isinstance(body.get("text"), str):
        raise RequestError(422, "text: Input should be a valid string")
    try:
        made = chunk_articles(_article(spark, body["text"]), "article_id", "text", **_cut(body))
    except ValueError as e:
        raise RequestError(422, str(e)) from None
    return {"chunks": [r.asDict() for r in made.drop("article_id").orderBy("index").collect()]}


def run_agent(spark: SparkSession, body: dict) -> dict:
    """The default task over a text: its plan, chunks, sections, context and trace."""
    made = agent_task(_article(spark, str(body.get("text", ""))), str(body.get("task", "")), **_cut(body))
    return made.drop("article_id").first().asDict(recursive=True)


def parse_pdf(name: str | None, data: bytes, parse: Callable[[bytes], dict]) -> dict:
    """A PDF file by a parsing plug-in; other and empty files are refused."""
    if not (name or "").lower().endswith(".pdf"):
        raise RequestError(400, "Only PDF files are supported.")
    if not data:
        raise RequestError(400, "Uploaded PDF is empty.")
    try:
        return parse(data)
    except Exception as e:
        raise RequestError(500, f"PDF parsing failed: {e}") from e
