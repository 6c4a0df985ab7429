"""Transports of model requests: one client for each partition, failures as data."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TIMEOUT = 120.0
_SCHEMA = "doc_id long, family_id string, kind string, response string, error string"


def per_partition(client: Callable[[], Callable[[str], str]]) -> Callable[[DataFrame], DataFrame]:
    """A transport that makes a client in each partition and gives it one request after the other.

    A request that fails has no response and its ``error`` instead: the status and the first 500 characters of the answer,
    or what kept the answer from coming. A task that is run again asks again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client()
        for batch in batches:
            responses, errors = [], []
            for request in batch.column(3).to_pylist():
                response = error = None
                try:
                    response = ask(request)
                    json.loads(response)
                except urllib.error.HTTPError as e:
                    error = f"Model API error {e.code}: {e.read().decode('utf-8', errors='replace')[:500]}"
                except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
                    response, error = None, f"Model transport failure: {e}"
                responses.append(response)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(responses, pa.string()), pa.array(errors, pa.string())], ["doc_id", "family_id", "kind", "response", "error"])

    return lambda asked: asked.select("doc_id", "family_id", "kind", "request").mapInArrow(run, _SCHEMA)


def http_client(url: str, key: str, timeout: float = TIMEOUT) -> Callable[[], Callable[[str], str]]:
    """Posts requests as JSON with the key as a bearer token."""

    def make() -> Callable[[str], str]:
        def ask(request: str) -> str:
            head = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
            with urllib.request.urlopen(urllib.request.Request(url, request.encode(), head, method="POST"), timeout=timeout) as answer:
                return answer.read().decode()

        return ask

    return make
