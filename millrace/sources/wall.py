"""Posts from walls of a social network's HTTP API, as a Python data source: a partition for each wall.

spark.dataSource.register(WallSource); spark.read.format("wall").option("access_token", …).option("sources", "club1,id2").load()
Rows are posts or errors: a wall that fails gives one row with error set, unless continue_on_error is false.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.operators.models import Pace
from millrace.operators.storage import kept

API = "https://api.vk.com/method"
VERSION = "5.199"
PAGE = 100
AGAIN = {1, 6, 9, 10, 29}
SCHEMA = "source_pos long, item_pos long, text string, raw_text string, source_name string, source_url string, published_at string, external_id string, is_pinned boolean, error string"
EMOJI = re.compile("[\U0001f1e6-\U0001f1ff\U0001f300-\U0001f5ff\U0001f600-\U0001f64f\U0001f680-\U0001faff☀-➿️]+")


class WallError(Exception):
    """A call that failed: the service's code and details, the method called and the wall, and whether trying again may help."""

    def __init__(self, message: str, code: int | None = None, retryable: bool = False, source: str | None = None, method: str | None = None, details: dict | None = None):
        super().__init__(message)
        self.code, self.retryable, self.source, self.method, self.details = code, retryable, source, method, details or {}

    def __reduce__(self):
        return type(self), (str(self), self.code, self.retryable, self.source, self.method, self.details)


@dataclass(frozen=True)
class Wall:
    """A wall by its owner's id (negative for groups) or its short name."""

    owner_id: int | None = None
    domain: str | None = None

    def __str__(self) -> str:
        return self.domain or str(self.owner_id)


def parse_wall(source: Wall | str | int) -> Wall:
    """A wall from an id, a short name (club1, public1 and id1 count as ids), a wall reference or a URL."""
    if isinstance(source, Wall):
        return source
    value = str(source).strip()
    if not value:
        raise ValueError("a wall's name can't be empty")
    if re.fullmatch(r"-*\d+", value):
        return Wall(int(value))
    url = urllib.parse.urlparse(value)
    if url.scheme and url.netloc:
        if url.netloc.lower().removeprefix("www.") not in ("vk.com", "m.vk.com"):
            raise ValueError("not a URL of this network")
        value = url.path.strip("/")
        if not value and (w := urllib.parse.parse_qs(url.query).get("w", [""])[0]).startswith("wall"):
            value = w
    name = value.strip().strip("/").split("/", 1)[0]
    if not name:
        raise ValueError("a wall's path can't be empty")
    if name.startswith("wall"):
        return Wall(int(name[4:].split("_", 1)[0]))
    if m := re.fullmatch(r"(club|public|id)(\d+)", name):
        return Wall(int(m[2]) * (1 if m[1] == "id" else -1))
    return Wall(domain=name)


def cleaned(text: str) -> str:
    return re.sub(r"\s+([,.:;!?])", r"\1", " ".join(EMOJI.sub("", text).split()))


def names_by_owner(response: dict) -> dict[int, str]:
    """Names of groups (by negative id) and profiles, which win."""
    found = {-g["id"]: g.get("name", "") for g in response.get("groups") or []}
    return found | {p["id"]: f"{p.get('first_name', '')} {p.get('last_name', '')}".strip() for p in response.get("profiles") or []}


def post_of(item: dict, wall: Wall, names: dict[int, str], name: str | None = None) -> dict | None:
    """A post's columns; None for a blank one."""
    if not isinstance(item.get("id"), int):
        raise WallError("an item without id", source=str(wall))
    owner = item.get("owner_id", wall.owner_id)
    text = item.get("text") if isinstance(item.get("text"), str) else ""
    raw = cleaned(text)
    if not raw:
        return None
    date = item.get("date")
    return {
        "text": text, "raw_text": raw, "source_name": name or names.get(owner) or wall.domain, "source_url": f"https://vk.com/wall{owner}_{item['id']}",
        "published_at": datetime.fromtimestamp(date, UTC).isoformat() if isinstance(date, int) else None,
        "external_id": f"vk:wall{owner}_{item['id']}", "is_pinned": bool(item.get("is_pinned")),
    }


def _get(url: str, timeout: float) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read().decode()


@dataclass
class WallClient:
    access_token: str
    timeout: float = 10.0
    retries: int = 3
    backoff: float = 1.0
    pace: Pace = field(default_factory=lambda: Pace(1 / 20))
    get: Callable[[str, float], str] = _get
    sleep: Callable[[float], None] = time.sleep

    def call(self, method: str, params: dict) -> dict:
        url = f"{API}/{method}?" + urllib.parse.urlencode(params | {"access_token": self.access_token, "v": VERSION})
        for attempt in range(self.retries + 1):
            self.pace.wait()
            wait, last = None, attempt == self.retries
            try:
                body = json.loads(self.get(url, self.timeout))
                if not isinstance(body, dict) or not isinstance(body.get("response", body.get("error")), dict):
                    raise WallError("an answer of another shape")
                if "error" not in body:
                    return body["response"]
                code = body["error"].get("error_code")
                failed = WallError(body["error"].get("error_msg", "error"), code, code in AGAIN, method=method, details=body["error"])
            except urllib.error.HTTPError as e:
                failed = WallError(f"HTTP {e.code}", e.code, e.code == 429 or e.code >= 500, method=method)
                if (said := (e.headers or {}).get("Retry-After")) is not None:
                    wait = float(said) if re.fullmatch(r"\d+(\.\d+)?", said) else 0.0
            except (urllib.error.URLError, TimeoutError) as e:
                failed = WallError(str(e), retryable=True, method=method)
            except ValueError as e:
                raise WallError("an answer that is no JSON") from e
            if not failed.retryable or last:
                raise failed
            self.sleep(min(30.0, self.backoff * 2**attempt) if wait is None else wait)
        raise AssertionError

    def page(self, wall: Wall, n: int, offset: int, only: str = "owner") -> dict:
        who = {"owner_id": wall.owner_id} if wall.owner_id is not None else {"domain": wall.domain}
        return self.call("wall.get", who | {"count": max(0, min(PAGE, n)), "offset": max(0, offset), "filter": only, "extended": 1})


def posts_of(client: WallClient, wall: Wall, limit: int = 100, offset: int = 0, only: str = "owner", batch: int = PAGE, cached_ids: frozenset = frozenset(), name: str | None = None) -> Iterator[dict]:
    """A wall's posts. Blank ones are left out and don't count for the limit; nor does a pinned post that is known already."""
    n = 0
    while n < limit:
        ask = min(batch, limit - n)
        response = client.page(wall, ask, offset, only)
        items = response.get("items") or []
        names = names_by_owner(response)
        for item in items:
            post = post_of(item, wall, names, name)
            if post is not None:
                yield post
                n += not (post["is_pinned"] and post["external_id"] in cached_ids)
        offset += len(items)
        if len(items) < ask:
            return


@dataclass
class OneWall(InputPartition):
    pos: int
    wall: Wall


class WallReader(DataSourceReader):
    def __init__(self, options: dict, client: Callable[[str], WallClient] = WallClient):
        self.options, self.client = options, client

    def partitions(self) -> list[OneWall]:
        return [OneWall(k, parse_wall(s)) for k, s in enumerate(self.options["sources"].split(","))]

    def read(self, partition: OneWall) -> Iterator[tuple]:
        o, k = self.options, -1
        known = frozenset(filter(None, o.get("cached_ids", "").split(",")))
        try:
            for k, p in enumerate(posts_of(self.client(o["access_token"]), partition.wall, int(o.get("limit", 100)), int(o.get("offset", 0)), o.get("filter", "owner"), int(o.get("batch", PAGE)), known)):
                yield (partition.pos, k, *p.values(), None)
        except WallError as e:
            if str(o.get("continue_on_error", "true")).lower() != "true":
                raise
            yield (partition.pos, k + 1, None, None, str(partition.wall), None, None, None, None, f"{e.code}: {e}")


class WallSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wall"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WallReader:
        return WallReader(dict(self.options))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts (POST's columns, in the order of walls and of their posts) and errors (source_pos, source_name, error) of the source's
    rows, which should be a written table, as reading them anew asks the walls again."""
    posts, errors = rows.where("error is null"), rows.where("error is not null").select("source_pos", "source_name", "error")
    # a row for each wall; a wall's posts are numbered from 0
    sizes = posts.groupBy("source_pos").agg(F.count("*").alias("n"))
    before = Window.orderBy("source_pos").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("source_pos", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    posts = posts.join(F.broadcast(shift), "source_pos").withColumn("post_pos", F.col("item_pos") + F.col("shift"))
    return posts.select("post_pos", "text", "raw_text", "source_name", "source_url", "published_at", "external_id", "is_pinned"), errors


@dataclass
class Walls:
    """The walls as a pipeline's source; read once a run and written to the shared folder. Known ids go to the reader as an option
    that grows with them; only those of pinned posts matter, so give the latest snapshot."""

    spark: object
    options: dict

    def posts(self, cached_ids: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        self.spark.dataSource.register(WallSource)
        known = "" if cached_ids is None else ",".join(r.external_id for r in cached_ids.where("external_id like 'vk:wall%'").toLocalIterator())
        return split(kept(self.spark.read.format("wall").options(**self.options, cached_ids=known).load()))
