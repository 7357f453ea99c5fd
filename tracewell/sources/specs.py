"""The four export files: columns, cleaners, what a row must have, and dialect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

from tracewell.functions import dates as D
from tracewell.functions import text as X

Cleaner = Callable[[Column], Column]


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    required: bool = False
    cleaner: Cleaner = X.clean_value
    width: int | None = None
    wrap: bool = False


@dataclass(frozen=True)
class ExportSpec:
    """row_required: columns a row must have; any_of: columns not all of which may be missing. A limit of 0 is none; zone is
    what times are turned to, the session's where it is not named."""

    kind: str
    columns: tuple[ColumnSpec, ...]
    row_required: tuple[str, ...]
    any_of: tuple[str, ...] = ()
    skip_rows: int = 0
    escape: str | None = None
    encoding: str | None = None
    max_bytes: int = 100 * 1024 * 1024
    max_rows: int = 1_000_000
    max_chars: int = 0
    max_columns: int = 0
    max_field_chars: int = 0
    zone: str | None = None
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        if min(self.max_bytes, self.max_rows, self.max_chars, self.max_columns, self.max_field_chars) < 0:
            raise ValueError("limits must not be negative; 0 disables one")
        object.__setattr__(self, "names", tuple(c.name for c in self.columns))

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns if c.required)


# The limits of files that a browser takes.
WEB_LIMITS = {"max_bytes": 80 * 1024 * 1024, "max_chars": 60 * 1024 * 1024, "max_rows": 500_000, "max_columns": 256, "max_field_chars": 200_000}


def _spec(kind: str, columns: list[ColumnSpec], **rest) -> ExportSpec:
    rest.setdefault("row_required", tuple(c.name for c in columns if c.required))
    return ExportSpec(kind, tuple(columns), **rest)


C = ColumnSpec
SHARES = _spec("shares", [C("Date", True, D.clean_utc), C("ShareLink", True), C("ShareCommentary", True, X.clean_commentary, 80, True), C("SharedUrl", False, X.clean_empty_field), C("MediaUrl", False, X.clean_empty_field), C("Visibility")])
COMMENTS = _spec("comments", [C("Date", True, D.clean_utc), C("Link", True), C("Message", True, X.clean_message, 80, True)], escape="\\")
MESSAGES = _spec("messages", [C("FROM", True), C("TO", True), C("DATE", True, D.clean_utc), C("CONTENT", True, X.clean_message, 80, True), C("FOLDER"), C("CONVERSATION ID"), C("SENDER PROFILE URL", False, X.clean_empty_field), C("RECIPIENT PROFILE URLS", False, X.clean_empty_field)])
CONNECTIONS = _spec(
    "connections",
    [C("First Name", True), C("Last Name", True), C("URL", False, X.clean_empty_field), C("Email Address", False, X.clean_empty_field), C("Company"), C("Position"), C("Connected On", True, D.clean_long_date)],
    row_required=("Connected On",),
    any_of=("First Name", "Last Name", "URL"),
    skip_rows=3,
)
#: In the order in which a file's kind is looked for.
SPECS = {s.kind: s for s in (SHARES, COMMENTS, MESSAGES, CONNECTIONS)}
