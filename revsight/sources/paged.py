"""Paged provider lists as a Python data source, for batch and for streams.

A client knows accounts and gives one page of an account's repositories at a time.  Pages of an account can only be asked
for in turn, since the first short page is the last; so each account is one partition, whose task asks for its pages in
turn, each once, and stops at a short one or at the limit.  A filter on ``account`` or ``page`` never reaches the client
for what it leaves out.

As a stream, an offset is the number of full pages and of records on the next one, by account: a page that has grown is
asked for again and only its new records are taken, so a restart goes on where the last batch ended.

Clients are named by ``module:callable``, which every executor can import, and made in the task with the option ``root``;
:class:`Landed` reads pages that were written as files.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Records of a full page, and pages of an account at most.
PER_PAGE, MOST_PAGES = 100, 100
FIELDS = {"id": "long", "name": "string", "full_name": "string", "description": "string", "html_url": "string", "clone_url": "string", "default_branch": "string", "language": "string", "private": "boolean", "archived": "boolean", "size": "long"}


class Client(Protocol):
    def accounts(self) -> list[str]: ...

    def page(self, account: str, number: int) -> list[dict]: ...


class Landed:
    """Pages in files: root/account/number.json, each a list of records; a file that isn't there is an empty page."""

    def __init__(self, root: str) -> None:
        self.root = Path(root.removeprefix("file://"))

    def accounts(self) -> list[str]:
        return sorted(p.name for p in self.root.iterdir() if p.is_dir())

    def page(self, account: str, number: int) -> list[dict]:
        path = self.root / account / f"{number}.json"
        return json.loads(path.read_text()) if path.exists() else []


def client_of(options: dict[str, str]) -> Client:
    module, _, name = options.get("client", f"{__name__}:Landed").partition(":")
    return getattr(importlib.import_module(module), name)(options["root"])


class Account(InputPartition):
    """Pages of an account from ``first`` on, without the first ``skip`` records of that page; ``full`` and ``rest`` end it."""

    def __init__(self, account: str, first: int = 1, skip: int = 0, full: int | None = None, rest: int = 0, pages: list[int] | None = None) -> None:
        super().__init__(account)
        self.account, self.first, self.skip, self.full, self.rest, self.pages = account, first, skip, full, rest, pages


def _records(client: Client, part: Account, per_page: int) -> Iterator[tuple]:
    last = MOST_PAGES if part.full is None else part.full + (part.rest > 0)
    for number in range(part.first, last + 1):
        if part.pages is not None and number > max(part.pages, default=0):
            return
        items = client.page(part.account, number)
        stop = part.rest if part.full is not None and number == part.full + 1 else len(items)
        if part.pages is None or number in part.pages:
            for item in items[part.skip if number == part.first else 0 : stop]:
                yield (part.account, number, *[item.get(f) for f in FIELDS])
        if len(items) < per_page:
            return


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.accounts: list[str] | None = None
        self.pages: list[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and IN on account and page; what is left is for Spark."""
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("account",):
                self.accounts = [a for a in wanted if a is not None and (self.accounts is None or a in self.accounts)]
            elif wanted is not None and f.attribute == ("page",):
                self.pages = [p for p in wanted if p is not None and (self.pages is None or p in self.pages)]
            else:
                yield f

    def partitions(self) -> list[Account]:
        known = client_of(self.options).accounts()
        return [Account(a, pages=self.pages) for a in known if self.accounts is None or a in self.accounts]

    def read(self, partition: Account) -> Iterator[tuple]:
        return _records(client_of(self.options), partition, int(self.options.get("per_page", PER_PAGE)))


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.per_page = options, int(options.get("per_page", PER_PAGE))
        self._seen: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """[full pages, records on the next] by account; goes on from the last one, so full pages aren't asked for again."""
        client, out = client_of(self.options), {}
        for account in client.accounts():
            full = self._seen.get(account, [0, 0])[0]
            rest = 0
            while full < MOST_PAGES and (rest := len(client.page(account, full + 1))) >= self.per_page:
                full, rest = full + 1, 0
            out[account] = [full, 0 if full >= MOST_PAGES else rest]
        self._seen = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Account]:
        return [Account(a, start.get(a, [0, 0])[0] + 1, start.get(a, [0, 0])[1], full, rest) for a, (full, rest) in sorted(end.items()) if [full, rest] != start.get(a, [0, 0])]

    def read(self, partition: Account) -> Iterator[tuple]:
        return _records(client_of(self.options), partition, self.per_page)

    def commit(self, end: dict) -> None:
        pass


class ProviderPages(DataSource):
    """``spark.read.format("provider_pages")`` once registered; options ``root``, ``client`` and ``per_page``."""

    @classmethod
    def name(cls) -> str:
        return "provider_pages"

    def schema(self) -> str:
        return "account string, page int, " + ", ".join(f"{n} {t}" for n, t in FIELDS.items())

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> PagedStream:  # noqa: ANN001, N802
        return PagedStream(dict(self.options))


def register(spark) -> None:  # noqa: ANN001
    """Make the format known to a session, with filters handed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderPages)
