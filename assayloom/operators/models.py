"""Plug-ins that ask outside helpers: chat models over a posting function, chemistry by RDKit where it is installed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators import validate as V
from assayloom.operators.extract import respond

#: Sends a chat request and returns the answer's body, a JSON text; runs on executors.
Post = Callable[[dict], str]
# What a call asks for.
MAX_TOKENS, TEMPERATURE = 2000, 0
TASKS = {True: "Extract properties of nanomaterials from the article chunk: sizes, kinetics, limits, optima, and process figures tied to a material.", False: "Extract antibacterial activities of small molecules from the article chunk; call normalised values pMIC."}


def request(model: str, prompt: str, schema: dict, form: str | None) -> dict:
    """A chat request. ``form``: json_schema, json_object, or None for a plain answer."""
    said = {"model": model, "max_tokens": MAX_TOKENS, "temperature": TEMPERATURE, "messages": [{"role": "system", "content": "Return one valid JSON object with a rows array only; an empty array where there is nothing to extract."}, {"role": "user", "content": prompt}]}
    if form == "json_schema":
        said["response_format"] = {"type": form, "json_schema": {"name": "rows", "strict": True, "schema": schema}}
    elif form:
        said["response_format"] = {"type": form}
    return said


def headers(token: str | None, env: dict[str, str]) -> dict[str, str]:
    """HTTP headers of a provider call: the token, and the site and name of the application where they are set."""
    pairs = {"Authorization": token and f"Bearer {token}", "HTTP-Referer": env.get("OPENROUTER_SITE_URL"), "X-Title": env.get("OPENROUTER_APP_NAME") or env.get("OPENROUTER_APP_TITLE")}
    return {k: v for k, v in pairs.items() if v}


def chat_asker(post: Post, model: str, nano: bool, forms: tuple[str | None, ...] = ("json_schema", "json_object"), token: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """An ``ask`` for ``with_retries`` and ``run_articles`` on a chat model.

    ``forms`` are the answer formats to try in turn, for services that refuse some. A chunk whose calls all fail has a
    null response; the error's text, without the token, is in ``error``.
    """
    fields = V.NANO_FIELDS if nano else V.MOLECULE_FIELDS
    schema = V.json_schema(fields)

    def call(prompt: str) -> str:
        for i, form in enumerate(forms):
            try:
                return post(request(model, prompt, schema, form))
            except Exception as e:  # the service may only refuse this format
                if i == len(forms) - 1:
                    said = str(e).replace(token, "<redacted>") if token else str(e)
                    raise RuntimeError(f"Extraction request failed: {type(e).__name__}: {said}") from None
        raise ValueError("no answer format is given")

    def answers(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([call(p) for p in pdf["text"]], index=pdf.index, dtype="object")

    def ask(chunks: DataFrame) -> DataFrame:
        asked = chunks.withColumn("text", V.prompt(F.col("text"), F.col("attempt"), F.col("errors"), TASKS[nano], list(fields), json.dumps(schema)))
        keys = [c for c in chunks.columns if c in ("article_id", "index", "k")]
        return respond(asked.select(*keys, "text"), answers, keys).withColumn("response", V.message_text(F.col("response")))

    return ask


def rdkit_canonical(x: Column, unreadable: str | None = None) -> Column:
    """Canonical SMILES by RDKit; ``unreadable`` for what can't be read; the text as it is where RDKit is not installed."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            from rdkit import Chem, RDLogger

            RDLogger.DisableLog("rdApp.error")
        except ImportError:
            yield from it
            return
        for texts in it:
            read = [None if t is None else Chem.MolFromSmiles(t) for t in texts.to_pylist()]
            yield pa.array([unreadable if m is None else Chem.MolToSmiles(m, canonical=True) for m in read], pa.string())

    return F.arrow_udf(run, "string")(x)


def rdkit_weight(x: Column) -> Column:
    """Molecular weights of SMILES by RDKit; null for what can't be read, and where RDKit is not installed."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            from rdkit import Chem
            from rdkit.Chem import Descriptors
        except ImportError:
            for texts in it:
                yield pa.nulls(len(texts), pa.float64())
            return
        for texts in it:
            read = [None if t is None else Chem.MolFromSmiles(t) for t in texts.to_pylist()]
            yield pa.array([None if m is None else float(Descriptors.MolWt(m)) for m in read], pa.float64())

    return F.arrow_udf(run, "double")(x)
