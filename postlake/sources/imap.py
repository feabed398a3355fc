"""Mailboxes over IMAP: account configuration, what is asked of a server, and a data source of chunks of messages.

spark.dataSource.register(ImapDataSource); spark.read.format("imap").options(**account.options()).load().
The driver lists the uids; every chunk of them is fetched by a task with a connection of its own,
so a lost task fetches its chunk again and nothing else.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 200
SCHEMA = "uid bigint, modseq bigint, internal_date string, flags array<string>, size bigint, thrid string, labels array<string>, raw binary"


@dataclass
class Account:
    """One mailbox of an account; several that share account_id are threaded together."""

    host: str
    username: str
    password: str
    port: int = 993
    tls: bool = True
    danger_skip_tls_verify: bool = False
    mailbox: str = "INBOX"
    account_id: str | None = None
    state_path: str | None = None

    def options(self) -> dict[str, str]:
        if not self.tls:
            raise ValueError("mail is only fetched over TLS")
        return {"host": self.host, "port": str(self.port), "username": self.username, "password": self.password, "mailbox": self.mailbox, "skipVerify": str(self.danger_skip_tls_verify).lower()}


def accounts(text: str) -> list[Account]:
    """The accounts of a TOML text: the list first, then a single one."""
    config = tomllib.loads(text)
    rows = [*config.get("accounts", []), *([config["account"]] if "account" in config else [])]
    known = set(Account.__dataclass_fields__)
    return [Account(**{k: v for k, v in r.items() if k in known}) for r in rows]


def fetch_items(modseq: bool, gmail: bool, headers: bool = False) -> str:
    """What is fetched of each message, by what the server can."""
    items = ["UID", "RFC822.HEADER" if headers else "RFC822", "INTERNALDATE", "FLAGS", "RFC822.SIZE"]
    return f"({' '.join(items + ['MODSEQ'] * modseq + ['X-GM-THRID', 'X-GM-LABELS'] * gmail)})"


def changed_since(modseq: int, vanished: bool, gmail: bool) -> str:
    """The same for messages that changed after modseq, with those that are gone where the server tells."""
    return f"{fetch_items(True, gmail)} (CHANGEDSINCE {modseq}{' VANISHED' * vanished})"


def chunked(uids: list[int], size: int = CHUNK) -> list[list[int]]:
    return [uids[i : i + size] for i in range(0, len(uids), size)]


def _field(head: str, name: str) -> str | None:
    found = re.search(rf"{name} (\"[^\"]*\"|\([^)]*\)|\S+?)(?=[ )]|$)", head)
    return found[1] if found else None


def message(head: str, raw: bytes | None) -> tuple:
    """A row of SCHEMA of the head and the literal of one FETCH response."""
    words = lambda x: [w.strip('"') for w in re.findall(r'"[^"]*"|[^\s()]+', x or "")]
    number = lambda x: int(x.strip("()")) if x else None
    date = _field(head, "INTERNALDATE")
    return (number(_field(head, "UID")), number(_field(head, "MODSEQ")), date.strip('"') if date else None, words(_field(head, "FLAGS")), number(_field(head, "RFC822.SIZE")), _field(head, "X-GM-THRID"), words(_field(head, "X-GM-LABELS")), raw)


def responses(data: list) -> Iterator[tuple]:
    """Rows of what a client's FETCH returned; what stands after a literal belongs to the message before it."""
    held: tuple[str, bytes] | None = None
    for part in data:
        if isinstance(part, tuple):
            if held:
                yield message(*held)
            held = (part[0].decode("utf-8", "replace"), bytes(part[1]))
        elif isinstance(part, bytes) and held:
            held = (f"{held[0]} {part.decode('utf-8', 'replace')}", held[1])
        elif isinstance(part, bytes) and b"UID" in part:
            yield message(part.decode("utf-8", "replace"), None)
    if held:
        yield message(*held)


def select(client, mailbox: str, unseen: bool = False, after: int = 0) -> list[int]:
    """The uids of a mailbox above after, or of its unseen messages."""
    client.select(f'"{mailbox}"', readonly=True)
    _, data = client.uid("SEARCH", None, "UNSEEN" if unseen else f"UID {after + 1}:*")
    return sorted(u for u in map(int, (data[0] or b"").split()) if u > after)


def fetch(client, uids: list[int], headers: bool = False) -> Iterator[tuple]:
    able = {str(c).upper() for c in getattr(client, "capabilities", ())}
    _, data = client.uid("FETCH", ",".join(map(str, uids)), fetch_items("CONDSTORE" in able, "X-GM-EXT-1" in able, headers))
    yield from responses(data)


def connect(options: dict):
    import imaplib
    import ssl

    context = ssl.create_default_context()
    if str(options.get("skipVerify", "false")).lower() == "true":
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
    client = imaplib.IMAP4_SSL(options["host"], int(options.get("port", 993)), ssl_context=context)
    client.login(options["username"], options["password"])
    return client


class Uids(InputPartition):
    def __init__(self, uids: list[int]) -> None:
        self.uids = uids


class ImapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.flag = lambda name: str(self.options.get(name, "false")).lower() == "true"

    def __getstate__(self) -> dict:
        return {"options": self.options}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["options"])

    def partitions(self) -> list[InputPartition]:
        client = connect(self.options)
        try:
            uids = select(client, self.options.get("mailbox", "INBOX"), self.flag("unseen"), int(self.options.get("after", 0)))
        finally:
            client.logout()
        return [Uids(x) for x in chunked(uids, int(self.options.get("chunk", CHUNK)))]

    def read(self, partition: Uids) -> Iterator[tuple]:
        client = connect(self.options)
        try:
            client.select(f'"{self.options.get("mailbox", "INBOX")}"', readonly=True)
            yield from fetch(client, partition.uids, self.flag("headersOnly"))
        finally:
            client.logout()


class ImapDataSource(DataSource):
    """Options: host, port (993), username, password, mailbox (INBOX), after (0), unseen (false), headersOnly (false), chunk (200), skipVerify (false)."""

    @classmethod
    def name(cls) -> str:
        return "imap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return ImapReader({k: o.get(k) for k in ("host", "port", "username", "password", "mailbox", "after", "unseen", "headersOnly", "chunk", "skipVerify") if o.get(k) is not None})
