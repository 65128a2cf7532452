"""Extractors that answer prompts (doc_id, chunk_no, prompt): one client for each partition, bounded retries, errors as rows.

An extractor is made anew in each task by a factory, which is all that travels. It says no more than the answer to one
prompt; what repeats, fails or doesn't fit is settled here, so that no answer stops a job. ``ask`` gives answers as they
came, ``extract.replay_strictly`` or ``checked`` hold them against a schema.

Defined cases: a null prompt is asked as ''; an empty table asks nothing and makes no client; rows alike are asked each;
a client that can't be made fails every row of its partition with ``client_unavailable``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .extract import payload, validation_errors

ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 0.5, 8.0
ANSWER = "json string, error string, attempts int, input_tokens long, output_tokens long"


class Answer(NamedTuple):
    json: str
    input_tokens: int | None = None
    output_tokens: int | None = None


class Passing(Exception):
    """A failure that may pass: the prompt is asked again, up to the bound."""


class Refused(Exception):
    """A failure that asking again doesn't mend; its text is the error of the row."""


class Extractor(Protocol):
    def answer(self, prompt: str) -> Answer: ...

    def close(self) -> None: ...


def asked(client: Extractor, prompt: str, attempts: int, wait: float) -> tuple:
    """One prompt to its end: (json, error, attempts, tokens in, tokens out)."""
    for n in range(1, attempts + 1):
        try:
            said = client.answer(prompt)
            return said.json, None, n, said.input_tokens, said.output_tokens
        except Passing as e:
            if n == attempts:
                return None, str(e) or "llm_unavailable", n, None, None
            time.sleep(min(LONGEST_WAIT, wait * 2 ** (n - 1)))
        except Refused as e:
            return None, str(e) or "llm_error", n, None, None
    raise ValueError("attempts must be 1 at least")


def ask(prompts: DataFrame, make: Callable[[], Extractor], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> DataFrame:
    """prompts without prompt, with json or error, the attempts made and the tokens used."""
    kept = [f for f in prompts.schema.fields if f.name != "prompt"]
    schema = T.StructType([*kept, *T.StructType.fromDDL(ANSWER).fields])
    types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, failed = None, None
        try:
            for batch in batches:
                rows = []
                for prompt in batch["prompt"].to_pylist():
                    if client is None and failed is None:
                        try:
                            client = make()
                        except Exception as e:
                            failed = f"client_unavailable: {e}"
                    rows.append((None, failed, 0, None, None) if client is None else asked(client, prompt or "", attempts, wait))
                columns = zip(*rows, strict=True) if rows else [[] for _ in types]
                yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)
        finally:
            if client is not None:
                client.close()

    return prompts.select(*[f.name for f in kept], "prompt").mapInArrow(work, schema)


def checked(answers: DataFrame, schema: T.StructType) -> DataFrame:
    """answers with facts where they are JSON of the schema, else error llm_response_invalid and what is wrong in details."""
    x = answers.withColumn("_body", payload(F.col("json")))
    wrong = F.when(F.col("error").isNull() & F.col("_body").isNotNull(), validation_errors(F.col("_body"), schema))
    x = x.select("*", F.explode(F.array(wrong)).alias("_wrong"))
    bad = F.col("error").isNull() & (F.col("_body").isNull() | (F.size("_wrong") > 0))
    details = F.when(F.size("_wrong") > 0, F.create_map(F.lit("errors"), F.to_json("_wrong")))
    x = x.withColumns({"error": F.when(bad, "llm_response_invalid").otherwise(F.col("error")), "details": F.when(bad, details)})
    return x.withColumn("facts", F.when(F.col("error").isNull(), F.from_json("_body", schema))).drop("_body", "_wrong", "json")
