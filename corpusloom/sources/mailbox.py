"""Sources of raw messages: trees of .eml files, and mailboxes by identifier ranges.

``EmlFiles`` reads a folder tree mailbox/folder/*.eml.  ``MailboxSource`` is a Python data source, batch
and streaming, over a mailbox that a *transport* serves; its offsets are, for each folder, the generation
and the last seen identifier.  A transport is any object with ``folders(wanted)``, ``uids(folder, wanted)``,
``sizes(folder, uids)`` and ``fetch(folder, uids)``, made on the executors by a registered factory.  ``wanted`` is what the
query's filters leave (see ``Wanted``): folders and identifiers that they exclude are neither opened nor listed, sized or fetched.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from ..functions.texts import BLOCKED_FLAGS, BLOCKED_FOLDERS, is_blocked_folder

BUDGET = 10 << 20
#: Characters of one identifier list in a command.
SET_MAX = 7000


def decode_mutf7(name: str) -> str:
    """Folder names in modified UTF-7; what can't be decoded stays as it is."""

    def one(m) -> str:
        if not m[1]:
            return "&"
        data = m[1].replace(",", "/")
        try:
            return base64.b64decode(data + "=" * (-len(data) % 4)).decode("utf-16-be")
        except ValueError:
            return m[0]

    return re.sub(r"&([^-&]*)-", one, name)


def is_blocked(name: str, flags: tuple[str, ...] = ()) -> bool:
    return any(f.lower() in BLOCKED_FLAGS for f in flags) or any(s.strip().lower() in BLOCKED_FOLDERS for s in re.split("[./]", name))


def compress(uids: list[int]) -> list[str]:
    """Sorted identifiers as comma-separated ranges, each list within the bound of a command."""
    runs: list[list[int]] = []
    for u in sorted(set(uids)):
        if runs and u == runs[-1][1] + 1:
            runs[-1][1] = u
        else:
            runs.append([u, u])
    lists = [""]
    for a, b in runs:
        text = str(a) if a == b else f"{a}:{b}"
        if lists[-1] and len(lists[-1]) + 1 + len(text) > SET_MAX:
            lists.append("")
        lists[-1] += ("," if lists[-1] else "") + text
    return [x for x in lists if x]


def batches(sizes: list[tuple[int, int | None]], budget: int = BUDGET) -> list[list[int]]:
    """Greedy batches of (uid, size) in order, one message at least; an unknown size is a whole budget."""
    out: list[list[int]] = []
    total = 0
    for uid, size in sizes:
        cost = budget if size is None else size
        if not out or (total and total + cost > budget):
            out.append([])
            total = 0
        out[-1].append(uid)
        total += cost
    return out


def eml_files(spark: SparkSession, root: str, org: str, connection: str, limit: int | None = None) -> DataFrame:
    """Rows of ``schemas.RAW_MESSAGE`` from mailbox/folder/*.eml, without blocked folders; ``limit`` takes a
    stride over the sorted paths rather than the first ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(root)
    rest = F.split(F.regexp_replace("path", "^" + re.escape(_url(root)) + "/*", ""), "/")
    rows = files.select(F.element_at(rest, 1).alias("mailbox"), F.when(F.size(rest) > 2, F.array_join(F.slice(rest, 2, F.size(rest) - 2), "/")).otherwise("INBOX").alias("folder"), "path", "modificationTime", F.col("content").alias("raw"))
    rows = rows.where(~is_blocked_folder(F.col("folder")))
    if limit is not None:
        names = rows.select("path").distinct()
        n = names.count()
        from ..operators.tables import every_nth

        rows = rows.join(every_nth(names, [F.col("path")], max(1, n // limit), limit), "path", "left_semi")
    ident = F.abs(F.xxhash64("path"))
    return rows.select(F.lit(org).alias("org_id"), F.lit(connection).alias("connection_id"), "mailbox", "folder", F.lit(1).cast("long").alias("uidvalidity"), ident.alias("uid"), ident.alias("seq"), "raw", F.col("modificationTime").alias("internal_date"))


def _url(root: str) -> str:
    return root.rstrip("/") if "://" in root or root.startswith("file:") else "file:" + root.rstrip("/")


@dataclass
class Wanted:
    """What filters leave of a mailbox: sets and prefixes of folders and generations, bounds of identifiers and of dates."""

    names: set[str] | None = None
    prefixes: list[str] = field(default_factory=list)
    generations: set[int] | None = None
    least: int = 1
    most: int | None = None
    uids: set[int] | None = None
    since: datetime | None = None
    before: datetime | None = None

    def folder(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(p) for p in self.prefixes)

    def generation(self, number: int) -> bool:
        return self.generations is None or number in self.generations

    def uid(self, uid: int) -> bool:
        return uid >= self.least and (self.most is None or uid <= self.most) and (self.uids is None or uid in self.uids)

    @property
    def empty(self) -> bool:
        return self.most is not None and self.most < self.least or any(x is not None and not x for x in (self.names, self.generations, self.uids))

    def take(self, f: Filter) -> bool:
        """Takes a filter in; true if nothing of it is left to be looked at again."""
        column = f.attribute if isinstance(f, IsNotNull | EqualTo | EqualNullSafe | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual | StringStartsWith) else None
        if column not in (("folder",), ("uidvalidity",), ("uid",), ("internal_date",)):
            return False
        name = column[0]
        if isinstance(f, IsNotNull):
            return name != "internal_date"
        if isinstance(f, StringStartsWith):
            if name == "folder":
                self.prefixes.append(f.value)
            return name == "folder"
        if isinstance(f, EqualTo | EqualNullSafe | In):
            values = set(f.value) if isinstance(f, In) else {f.value}
            values.discard(None)
            if name == "internal_date":
                if values:
                    self._dates(min(values), max(values))
                return False
            slot = {"folder": "names", "uidvalidity": "generations", "uid": "uids"}[name]
            known = getattr(self, slot)
            setattr(self, slot, values if known is None else known & values)
            return True
        if f.value is None:
            return False
        above = isinstance(f, GreaterThan | GreaterThanOrEqual)
        if name == "uid":
            if above:
                self.least = max(self.least, f.value + isinstance(f, GreaterThan))
            else:
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            return True
        if name == "internal_date":
            self._dates(f.value if above else None, None if above else f.value)
        return False

    def _dates(self, since, before) -> None:
        """Servers search by days, and by those of their own zone: a day more at both ends."""
        plain = lambda x: x if x.tzinfo else x.replace(tzinfo=UTC)
        if since is not None:
            since = plain(since) - timedelta(days=1)
            self.since = since if self.since is None else max(self.since, since)
        if before is not None:
            before = plain(before) + timedelta(days=2)
            self.before = before if self.before is None else min(self.before, before)


ALL = Wanted()


#: Factories of transports by name: options -> transport. Register at import, so executors have them as well.
TRANSPORTS: dict[str, Callable[[dict], object]] = {}


class MaildirTransport:
    """Files root/folder/<uid>.eml; the generation of a folder is in root/folder/.uidvalidity, else 1."""

    def __init__(self, options: dict):
        import pathlib

        self.root = pathlib.Path(options["root"])

    def folders(self, wanted: Wanted = ALL) -> list[tuple[str, int, tuple[str, ...]]]:
        found = []
        for p in sorted(x for x in self.root.iterdir() if x.is_dir() and wanted.folder(x.name)):
            mark = p / ".uidvalidity"
            found.append((p.name, int(mark.read_text()) if mark.exists() else 1, ()))
        return found

    def uids(self, folder: str, wanted: Wanted = ALL) -> list[int]:
        return sorted(u for p in (self.root / folder).glob("*.eml") if wanted.uid(u := int(p.stem)))

    def sizes(self, folder: str, uids: list[int]) -> dict[int, int]:
        return {u: (self.root / folder / f"{u}.eml").stat().st_size for u in uids}

    def fetch(self, folder: str, uids: list[int]) -> Iterator[tuple[int, bytes, datetime | None]]:
        for u in uids:
            yield u, (self.root / folder / f"{u}.eml").read_bytes(), None


def listed(item: bytes | tuple[bytes, bytes]) -> tuple[str, tuple[str, ...]] | None:
    """Name and flags of a folder in a line of a LIST answer; None for what can't be selected or isn't such a line.

    A name comes quoted, bare, or, where it holds odd bytes, after the line by itself."""
    line, literal = (item if isinstance(item, tuple) else (item, None)) or (b"", None)
    found = re.match(rb'\s*\(([^)]*)\)\s+(?:NIL|"(?:[^"\\]|\\.)*")\s+(.*?)\s*$', line or b"", re.IGNORECASE | re.DOTALL)
    if not found:
        return None
    flags = tuple(found[1].decode("latin-1").split())
    if "\\noselect" in (f.lower() for f in flags):
        return None
    name = found[2] if literal is None else literal
    if literal is None and len(name) > 1 and name[:1] == name[-1:] == b'"':
        name = re.sub(rb"\\(.)", rb"\1", name[1:-1], flags=re.DOTALL)
    return name.decode("latin-1"), flags


def received_at(line: bytes) -> datetime | None:
    """The server's date in a line of a FETCH answer, in UTC."""
    found = re.search(rb'INTERNALDATE "([^"]+)"', line, re.IGNORECASE)
    try:
        return datetime.strptime(found[1].decode("ascii").strip(), "%d-%b-%Y %H:%M:%S %z").astimezone(UTC) if found else None
    except ValueError:
        return None


def _day(at: datetime) -> str:
    """A day as searches name it, whatever the language of the machine."""
    return f"{at.day}-{'Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec'.split()[at.month - 1]}-{at.year}"


def _connect(options: dict):
    import imaplib

    client = imaplib.IMAP4_SSL(options["host"], int(options.get("port", 993)))
    client.login(options["user"], os.environ[options["passwordenv"]])
    return client


class ImapTransport:
    """A mailbox on a server. Options: host, port, user, and ``passwordenv``, the environment variable with the password,
    which is thus in no plan.  Nothing is marked as read.  What the server doesn't answer stays out, and so unsettled."""

    def __init__(self, options: dict, connect: Callable = _connect):
        self.client = connect(options)

    def _select(self, folder: str) -> int | None:
        """The folder's generation; None if it can't be selected or has none."""
        quoted = folder.replace("\\", "\\\\").replace('"', '\\"')
        try:
            answer, _ = self.client.select(f'"{quoted}"'.encode("latin-1"), readonly=True)
        except UnicodeEncodeError:
            return None
        _, values = self.client.response("UIDVALIDITY") if answer == "OK" else (None, None)
        return int(values[0]) or None if values and values[0] else None

    def _fetched(self, uids: list[int], what: str):
        for part in compress(uids):
            answer, items = self.client.uid("FETCH", part, what)
            for item in items or [] if answer == "OK" else []:
                line, data = item if isinstance(item, tuple) else (item, None)
                if line and (uid := re.search(rb"\bUID (\d+)", line)):
                    yield int(uid[1]), line, data

    def folders(self, wanted: Wanted = ALL) -> list[tuple[str, int, tuple[str, ...]]]:
        answer, items = self.client.list()
        found = [x for x in map(listed, items or []) if x and wanted.folder(x[0])] if answer == "OK" else []
        return [(name, generation, flags) for name, flags in found if not is_blocked(decode_mutf7(name), flags) and (generation := self._select(name))]

    def uids(self, folder: str, wanted: Wanted = ALL) -> list[int]:
        sets = compress(list(wanted.uids)) if wanted.uids is not None else [f"{wanted.least}:{wanted.most or '*'}"]
        days = [x for key, day in (("SINCE", wanted.since), ("BEFORE", wanted.before)) if day for x in (key, _day(day))]
        found: set[int] = set()
        for part in sets if self._select(folder) else []:
            answer, items = self.client.uid("SEARCH", "UID", part, *days)
            if answer == "OK" and items and items[0]:
                found |= set(map(int, items[0].split()))
        # the last one is listed even if it is below
        return sorted(filter(wanted.uid, found))

    def sizes(self, folder: str, uids: list[int]) -> dict[int, int]:
        self._select(folder)
        return {uid: int(size[1]) for uid, line, _ in self._fetched(uids, "(UID RFC822.SIZE)") if (size := re.search(rb"RFC822\.SIZE (\d+)", line))}

    def fetch(self, folder: str, uids: list[int]) -> Iterator[tuple[int, bytes, datetime | None]]:
        self._select(folder)
        for uid, line, data in self._fetched(uids, "(UID INTERNALDATE BODY.PEEK[])"):
            if data is not None:
                yield uid, data, received_at(line)


TRANSPORTS |= {"maildir": MaildirTransport, "imap": ImapTransport}

SCHEMA = "folder string, uidvalidity long, uid long, raw binary, internal_date timestamp"


class Part(InputPartition):
    def __init__(self, folder: str, generation: int, uids: list[int]):
        self.folder, self.generation, self.uids = folder, generation, uids


class _Reading:
    def __init__(self, options: dict):
        self.options = dict(options)
        self.budget = int(self.options.get("maxbytes", BUDGET))

    def transport(self):
        return TRANSPORTS[self.options.get("transport", "maildir")](self.options)

    def read(self, part: Part):
        for uid, raw, at in self.transport().fetch(part.folder, part.uids):
            yield part.folder, part.generation, uid, raw, at

    def folders(self, transport, wanted: Wanted = ALL) -> list[tuple[str, int]]:
        found = [(name, generation) for name, generation, flags in transport.folders(wanted) if not is_blocked(decode_mutf7(name), flags)]
        return [(name, generation) for name, generation in found if wanted.folder(name) and wanted.generation(generation)]


class BatchReader(_Reading, DataSourceReader):
    """Batches of the messages that the query's filters leave: filters on folder, generation and identifier are done with,
    those on the date are narrowed to days and looked at again by Spark."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        return [f for f in filters if not self.wanted.take(f)]

    def partitions(self):
        if self.wanted.empty:
            return [Part("", 0, [])]
        transport, parts = self.transport(), []
        for folder, generation in self.folders(transport, self.wanted):
            uids = transport.uids(folder, self.wanted)
            sizes = transport.sizes(folder, uids)
            parts += [Part(folder, generation, b) for b in batches([(u, sizes.get(u)) for u in uids], self.budget)]
        return parts or [Part("", 0, [])]

    def read(self, part: Part):
        return super().read(part) if part.uids else iter(())


class StreamReader(_Reading, DataSourceStreamReader):
    """Each trigger takes one batch of a budget of bytes from every folder."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.seen: dict = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"folders": "{}"}

    def _after(self, state: dict, folder: str, generation: int) -> int:
        was = state.get(folder)
        return was[1] + 1 if was and was[0] == generation else 1

    def latestOffset(self) -> dict:  # noqa: N802
        transport, state = self.transport(), dict(self.seen)
        for folder, generation in self.folders(transport):
            least = self._after(state, folder, generation)
            uids = transport.uids(folder, Wanted(least=least))
            if uids:
                sizes = transport.sizes(folder, uids)
                state[folder] = [generation, batches([(u, sizes.get(u)) for u in uids], self.budget)[0][-1]]
            elif folder not in state or state[folder][0] != generation:
                state[folder] = [generation, 0]
        self.seen = state
        return {"folders": json.dumps(state, sort_keys=True)}

    def partitions(self, start: dict, end: dict):
        before, after, transport = json.loads(start["folders"]), json.loads(end["folders"]), self.transport()
        self.seen = {**self.seen, **after}
        parts = []
        for folder, (generation, last) in sorted(after.items()):
            uids = transport.uids(folder, Wanted(least=self._after(before, folder, generation), most=last))
            if uids:
                parts.append(Part(folder, generation, uids))
        return parts or [Part("", 0, [])]

    def commit(self, end: dict) -> None:
        self.seen = {**self.seen, **json.loads(end["folders"])}

    def read(self, part: Part):
        return iter(list(super().read(part)) if part.uids else [])


class MailboxSource(DataSource):
    """``spark.read.format("mailbox")`` and ``spark.readStream.format("mailbox")``; options: transport, maxbytes
    and those of the transport."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MailboxSource)
