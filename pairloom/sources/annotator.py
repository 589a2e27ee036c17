"""Annotation of questions by a server: many requests in flight a task, retries with growing waits, nothing lost."""

from __future__ import annotations

import http.client
import json
import threading
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import batched
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.splits import SENTENCE, TOKEN, sentence
from pairloom.sources.tables import shared_table

# What the server is asked for, and the characters that texts lose that it cannot take.
PROPERTIES = {"annotators": "tokenize,ssplit,pos,parse,ner,depparse", "outputFormat": "json"}
STRIPPED = "%\"'"
#: A task sends so many texts to its threads at a time; their answers go out before the next ones.
TEXTS = 200


class Refused(Exception):
    """The server answered, but not with an annotation of this text."""


@dataclass
class Server:
    """url of the server; requests in flight a task; tries of a request that gets no answer; first wait, which doubles; seconds to an answer."""

    url: str
    in_flight: int = 4
    tries: int = 4
    wait: float = 0.2
    timeout: float = 60.0
    properties: dict = field(default_factory=lambda: dict(PROPERTIES))


class Client:
    """One task's side: each thread keeps its connection."""

    def __init__(self, server: Server):
        self.server, self.own = server, threading.local()
        parts = urlsplit(server.url)
        self.kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
        self.host, self.path = parts.netloc, f"{parts.path or '/'}?properties={quote(json.dumps(server.properties))}"

    def ask(self, text: str) -> dict:
        """The first sentence of the answer; Refused if it is no annotation, OSError if there is none."""
        if getattr(self.own, "connection", None) is None:
            self.own.connection = self.kind(self.host, timeout=self.server.timeout)
        try:
            self.own.connection.request("POST", self.path, text.encode("utf-8", "replace"), {"Content-Type": "text/plain; charset=utf-8"})
            answer = self.own.connection.getresponse()
            body = answer.read()
        except (OSError, http.client.HTTPException) as e:
            self.own.connection.close()
            self.own.connection = None
            raise OSError(str(e)) from e
        if answer.status >= 500 or answer.status == 429:
            raise OSError(f"status {answer.status}")
        try:
            return json.loads(body)["sentences"][0]
        except (ValueError, LookupError, TypeError) as e:
            raise Refused(text) from e

    def annotate(self, text: str) -> list[dict] | None:
        """Tokens of a text: once more without STRIPPED if it is refused; null if that is, too, or if no try is answered."""
        for attempt in (text, text.translate({ord(c): None for c in STRIPPED})):
            for k in range(self.server.tries):
                if k:
                    time.sleep(self.server.wait * 2 ** (k - 1))
                try:
                    first = self.ask(attempt)
                    return sentence({"toks": first["tokens"], "deps": first["basicDependencies"]})
                except OSError:
                    continue
                except (Refused, LookupError, TypeError):
                    break
            else:
                return None
        return None


def annotate_by_server(pairs: DataFrame, server: Server, tasks: int | None = None, columns: tuple[str, str] = ("question1", "question2")) -> DataFrame:
    """(pair_id, s, t): the annotated questions of each pair, null where the server has no annotation; every pair stays.

    Each different text is sent once, by `tasks` tasks (Spark's default if unset) with server.in_flight requests each, so that
    the server sees tasks x in_flight requests at once at most. Null texts are the text 'Null'.
    """
    texts = pairs.select("pair_id", *[F.coalesce(F.col(c), F.lit("Null")).alias(n) for c, n in zip(columns, ("a", "b"), strict=True)])
    different = texts.select(F.explode(F.array("a", "b")).alias("text")).distinct()
    different = different.repartition(tasks, "text") if tasks else different

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(server)
        with ThreadPoolExecutor(server.in_flight) as pool:
            for batch in batches:
                for some in batched(batch.column(0).to_pylist(), TEXTS):
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(list(pool.map(client.annotate, some)), pa.list_(TOKEN))], names=["text", "tokens"])

    found = different.mapInArrow(run, f"text string, tokens {SENTENCE}")
    found = shared_table(found, "annotations")  # else both joins would ask the server
    side = lambda key, name: found.select(F.col("text").alias(key), F.col("tokens").alias(name))
    return texts.join(side("a", "s"), "a").join(side("b", "t"), "b").select("pair_id", "s", "t")
