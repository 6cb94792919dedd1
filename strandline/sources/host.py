"""Host-side pieces of the sources: settings, retries, budgets, pacing, and an HTTP source of JSON records."""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields
from itertools import count

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, FractionalType, IntegralType, MapType, StringType, StructType

from ..errors import OverBudget, SourceError
from ..operators.prompts import cited_urls

#: Fixed values of the sources' protocols.
RETRIED = (429, 500, 502, 503, 504)
LONGEST_WAIT, IDS_AT_ONCE, DOIS_AT_ONCE = 10.0, 50, 25
NEIGHBOUR_FIELDS, PAPER_FIELDS = ("intents", "isInfluential"), ("paperId", "externalIds", "title", "abstract", "year", "venue", "citationCount", "authors")


@dataclass(frozen=True)
class Settings:
    total_cap: int = 500
    fanout_cap: int = 100
    top_k: int = 40
    shortlist: int = 120
    max_keep: int = 35
    strategy: str = "top_cited"
    mode: str = "auto"
    retries: int = 3
    timeout_s: float = 30.0
    neighbour_requests: int = 12
    neighbour_interval_s: float = 1.1
    cache: bool = True
    chat_url: str = ""
    chat_model: str = ""
    chat_key: str = ""
    web_search: bool = True

    def chat(self, model: str | None = None, web: bool = False) -> Callable[[list[dict]], str] | None:
        """The model that the settings name, or ``model`` at their address; None without an address, a key and a name."""
        named = model or self.chat_model
        return chat_model(self.chat_url, named, self.chat_key, http_post(max(120.0, self.timeout_s)), self.retries, web_results=5 if web else 0) if self.chat_url and self.chat_key and named else None

    @staticmethod
    def file_values(text: str) -> dict[str, str]:
        """``NAME=value`` lines of a settings file; blank lines, comments, an ``export`` before and quotes around are skipped."""
        out = {}
        for line in text.splitlines():
            name, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
        return out

    @classmethod
    def load(cls, path: str, env: Mapping[str, str] = os.environ) -> Settings:
        """Values of a settings file, where there is one, under those of the environment."""
        try:
            with open(path, encoding="utf-8") as f:
                told = cls.file_values(f.read())
        except FileNotFoundError:
            told = {}
        return cls.from_env(told | dict(env))

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "STRANDLINE_") -> Settings:
        """Typed values of ``PREFIX_NAME`` variables; unset, empty and malformed ones keep the default."""
        got = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper(), "").strip()
            kind = type(f.default)
            try:
                if raw:
                    got[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            except ValueError:
                pass
        return cls(**got)

    def clamped(self, ceilings: Mapping[str, int], **asked: int | None) -> Settings:
        """Asked-for caps, none above its ceiling; what isn't asked for stays, but for the ceiling."""
        return type(self)(**{**self.__dict__, **{k: min(asked.get(k) or getattr(self, k), top) for k, top in ceilings.items()}})


def retry_wait(headers: Mapping[str, str], attempt: int) -> float:
    """What the server asks for, ten seconds at most, else twice as long each time."""
    try:
        return min(float(headers["Retry-After"]), LONGEST_WAIT)
    except (KeyError, ValueError, TypeError):
        return float(2**attempt)


def nested_fields(key: str) -> str:
    """The field list that asks for a neighbour and no more."""
    return ",".join([*NEIGHBOUR_FIELDS, *(f"{key}.{f}" for f in PAPER_FIELDS)])


def batches(keys: list[str], size: int) -> list[list[str]]:
    return [keys[i : i + size] for i in range(0, len(keys), size)]


def dealt_slots(place: int, parts: int, began: float, interval_s: float, budget: int | None) -> Iterator[float]:
    """When the requests of one of ``parts`` tasks may go: every part's first come before any second, an interval apart, and none of all is beyond the budget. So many tasks keep one pace and one budget without speaking to each other."""
    for nth in count():
        slot = nth * parts + place
        if budget is not None and slot >= budget:
            return
        yield began + slot * interval_s


class Client:
    """GET with retries, a budget over a run (retries count) and a least time between requests; the first goes at once.

    With ``slots``, times that were dealt to it, a request waits for the next of them, and there are no more than that.
    """

    def __init__(self, get: Callable[[str], tuple[int, Mapping[str, str], bytes]], retries: int = 3, budget: int | None = None, interval_s: float = 0.0, sleep=time.sleep, clock=time.monotonic, slots: Iterator[float] | None = None, now=time.time):
        self.get, self.retries, self.budget, self.interval, self.sleep, self.clock = get, retries, budget, interval_s, sleep, clock
        self.slots, self.now = slots, now
        self.made, self.last, self.lock = 0, None, threading.Lock()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *problem) -> None:
        """A closed client has no budget left; ``made`` still tells its requests."""
        self.budget = self.made

    def fetch(self, url: str) -> dict:
        if self.budget is not None and self.made >= self.budget:
            raise OverBudget(f"{self.made} requests were made")
        problem = "no attempt was made"
        for attempt in range(max(1, self.retries)):
            with self.lock:
                if self.slots is not None:
                    if (at := next(self.slots, None)) is None:
                        raise OverBudget(f"{self.made} requests were made, which is this task's share; last: {problem}")
                    if (wait := at - self.now()) > 0:
                        self.sleep(wait)
                if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
                    self.sleep(wait)
                self.last = self.clock()
                self.made += 1
            try:
                status, headers, body = self.get(url)
            except OSError as e:
                status, headers, body, problem = 0, {}, b"", str(e)
            if 200 <= status < 300:
                return json.loads(body)
            if status and status not in RETRIED:
                raise SourceError(f"{status} for {url}")
            problem = f"status {status}" if status else problem
            if attempt + 1 < self.retries:
                self.sleep(retry_wait(headers, attempt))
        raise SourceError(f"{problem} for {url}")


def http_get(timeout_s: float = 30.0, headers: Mapping[str, str] | None = None):
    def get(url: str):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers or {})), timeout=timeout_s) as r:
                return r.status, dict(r.headers), r.read()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read()

    return get


def http_post(timeout_s: float = 120.0):
    def post(url: str, headers: Mapping[str, str], body: bytes):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data=body, headers=dict(headers)), timeout=timeout_s) as r:
                return r.status, dict(r.headers), r.read()
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), e.read()

    return post


class Reply(str):
    """A model's text, with the addresses that it cites and the model that answered."""

    urls: list[str] = []
    model: str = ""


def chat_model(url: str, model: str, key: str, post=None, retries: int = 3, temperature: float = 0.2, sleep=time.sleep, web_results: int = 0) -> Callable[[list[dict]], str]:
    """A language model behind a chat-completions address, as the function that the plans take: messages in, JSON text out, a Reply.

    With ``web_results`` the model is asked to look that many pages up first.
    """
    post = post or http_post()
    looking = {"plugins": [{"id": "web", "max_results": web_results}]} if web_results else {}

    def chat(messages: list[dict]) -> str:
        body = json.dumps({"model": model, "messages": messages, "temperature": temperature, "response_format": {"type": "json_object"}} | looking).encode()
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        once = Client(lambda u: post(u, headers, body), retries, sleep=sleep)
        reply = once.fetch(url)
        try:
            message = reply["choices"][0]["message"]
            text = message["content"]
        except (KeyError, IndexError, TypeError):
            raise SourceError(f"no message in the reply: {str(reply)[:300]}") from None
        if not isinstance(text, str) or not text.strip():
            raise SourceError("the message is empty")
        out = Reply(text)
        out.urls, out.model = cited_urls(message), str(reply.get("model") or model)
        return out

    return chat


@dataclass
class Batch(InputPartition):
    """One request's URL and the column that it was asked by, with the task's place among all that share pace and budget."""

    url: str
    by: tuple[str, object] | None
    place: int
    parts: int
    began: float


class JsonApi(DataSource):
    """``spark.read.format("json_api")``: a JSON record in each row, asked for by key in batches.

    Options: ``url`` with ``{keys}`` where a batch goes, ``keys`` (commas
    between), ``batch`` (50), ``separator`` (``|``), ``results`` (the reply's
    list, ``results``), ``mailto`` and ``api_key`` (who asks), ``params`` (more
    query text), ``retries`` and ``timeout``. A batch is a partition, so a failed one is asked for again
    by Spark as well.

    Without a schema a row is the record as text, ``raw``. With one, its
    columns are the records' fields, and ``select`` names the query parameter
    that asks for these and no more. Filters on them are pushed (for which the
    session's spark.sql.python.filterPushdown.enabled has to be on; ``pushdown``
    ``false`` does without): ``id IN (...)``
    and ``id = ...`` give the keys, and a column with an option
    ``by.<column>``, a URL with ``{value}``, is asked for by the values that it
    is compared with and holds the value itself. Spark still tests every row.
    A read without keys and without such a filter is an error.

    ``interval`` (seconds between requests) and ``budget`` (requests, retries
    among them) hold for the whole read: their slots are dealt to the batches
    when it is planned, from ``lead`` (2) seconds on, by when tasks run. A batch
    has its share of the budget and no other's, so retries of one may end while
    another's are unused. A read that would need more first requests than the
    budget has fails before any is made.
    """

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema) -> DataSourceReader:
        # A session without push-down refuses a reader that takes filters.
        takes = schema.names != ["raw"] and self.options.get("pushdown", "true") == "true"
        return (FilteredReader if takes else JsonApiReader)(dict(self.options), schema)


def _as(value, kind):
    """A JSON value as a column's type has it; what doesn't fit is null."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, IntegralType):
        return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == int(value) else None
    if isinstance(kind, FractionalType):
        return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    if isinstance(kind, ArrayType):
        return [_as(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, MapType):
        return {k: _as(x, kind.valueType) for k, x in value.items()} if isinstance(value, dict) else None
    if isinstance(kind, StructType):
        return tuple(_as(value.get(f.name), f.dataType) for f in kind.fields) if isinstance(value, dict) else None
    return None


class JsonApiReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema
        self.keys = [k.strip() for k in options.get("keys", "").split(",") if k.strip()]
        self.asked: list[str] | None = None
        self.by: tuple[str, list] | None = None

    @property
    def typed(self) -> bool:
        return self.schema.names != ["raw"]

    def partitions(self) -> list[InputPartition]:
        o = self.options
        began = time.time() + (float(o.get("lead", 2)) if o.get("interval") else 0)
        keys = self.keys if self.asked is None else [k for k in dict.fromkeys(self.asked) if not self.keys or k in set(self.keys)]
        quote = lambda text, safe: urllib.parse.quote(text, safe=safe)
        if keys or self.asked is not None or not self.by:
            if not keys and self.asked is None and self.typed:
                raise SourceError("a read by json_api needs keys, or a filter on id or on a column with an option by.<column>")
            urls = [(o["url"].replace("{keys}", quote(o.get("separator", "|").join(b), ":/|,")), None) for b in batches(list(dict.fromkeys(keys)), int(o.get("batch", IDS_AT_ONCE)))]
        else:
            column, values = self.by
            urls = [(o[f"by.{column}"].replace("{value}", quote(str(v), ":/")), (column, v)) for v in dict.fromkeys(values)]
        if (budget := o.get("budget")) is not None and len(urls) > int(budget):
            raise OverBudget(f"the read takes {len(urls)} requests, {budget} are allowed")
        return [Batch(self._whole(url), by, place, len(urls), began) for place, (url, by) in enumerate(urls)] or [Batch("", None, 0, 1, began)]

    def _whole(self, url: str) -> str:
        o = self.options
        who = urllib.parse.urlencode({k: o[k] for k in ("mailto", "api_key") if o.get(k)})
        held = {c.removeprefix("by.") for c in o if c.startswith("by.")}
        fields = ",".join(n for n in self.schema.names if n not in held) if self.typed and o.get("select") else ""
        for more in (who, f"{o.get('select')}={fields}" if fields else "", o.get("params")):
            if more:
                url += ("&" if "?" in url else "?") + more
        return url

    def read(self, partition):
        if partition is None or not partition.url:
            return
        o = self.options
        slots = None
        if o.get("interval") or o.get("budget"):
            slots = dealt_slots(partition.place, partition.parts, partition.began, float(o.get("interval", 0)), int(o["budget"]) if o.get("budget") else None)
        client = Client(http_get(float(o.get("timeout", 30))), int(o.get("retries", 3)), slots=slots)
        for record in client.fetch(partition.url).get(o.get("results", "results")) or []:
            if not self.typed:
                yield (json.dumps(record),)
            elif isinstance(record, dict):
                own = dict([partition.by]) if partition.by else {}
                yield tuple(own[f.name] if f.name in own else _as(record.get(f.name), f.dataType) for f in self.schema.fields)


class FilteredReader(JsonApiReader):
    """A typed read that is planned by its filters."""

    def pushFilters(self, filters):
        """Take the values to ask by; every filter is given back, as a reply may hold more than was asked for."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1:
                values = [v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None]
                column = f.attribute[0]
                if column == "id":
                    some = [str(v) for v in values]
                    self.asked = some if self.asked is None else [k for k in self.asked if k in set(some)]
                elif f"by.{column}" in self.options and self.by is None:
                    self.by = (column, values)
        return list(filters)
