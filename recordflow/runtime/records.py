"""Records of a text, one after the other, under a separator that may change."""

from __future__ import annotations

import re
from collections.abc import Iterator

from recordflow.runtime.ere import compile_ere


class TextReader:
    """Records cut from a whole text."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def next(self, rs: str, csv: bool = False) -> tuple[str, str] | None:
        """A record and its terminator, or None at the end."""
        s, at, n = self.text, self.at, len(self.text)
        if csv:
            return self._csv()
        if rs == "":
            while at < n and s[at] == "\n":
                at += 1
            if at >= n:
                self.at = n
                return None
            m = re.compile("\n\n+").search(s, at)
            if m is None:
                self.at = n
                body = s[at:]
                return (body[:-1], "\n") if body.endswith("\n") else (body, "")
            self.at = m.end()
            return s[at : m.start()], m[0]
        if at >= n:
            return None
        if len(rs) == 1:
            end = s.find(rs, at)
            found = (end, end + 1) if end >= 0 else None
        else:
            ere = compile_ere(rs)
            found = ere.search(s, at)
            while found and found[0] == found[1]:
                found = ere.search(s, found[0] + 1) if found[0] < n else None
        if found is None:
            self.at = n
            body = s[at:]
            return body, ""
        self.at = found[1]
        return s[at : found[0]], s[found[0] : found[1]]

    def _csv(self) -> tuple[str, str] | None:
        s, at, n = self.text, self.at, len(self.text)
        if at >= n:
            return None
        quoted, i = False, at
        while i < n:
            c = s[i]
            if c == '"':
                quoted = not quoted
            elif c == "\n" and not quoted:
                break
            i += 1
        self.at = min(n, i + 1)
        body = s[at:i].replace("\r\n", "\n") if '"' in s[at:i] else s[at:i]
        return (body[:-1] if body.endswith("\r") else body), s[i : i + 1]


class Listed:
    """Records that were cut before, as (record, terminator) pairs or plain records."""

    def __init__(self, records: Iterator):
        self.records = iter(records)

    def next(self, rs: str, csv: bool = False) -> tuple[str, str] | None:
        r = next(self.records, None)
        return None if r is None else r if isinstance(r, tuple) else (r, "\n")


def csv_fields(record: str) -> list[str]:
    """Fields of a CSV record. A quote closes a field only before a comma or the end; what
    follows a closing quote is kept; a field that isn't closed runs to the end."""
    if record == "":
        return []
    out, at, n = [], 0, len(record)
    while True:
        if record.startswith('"', at):
            at += 1
            part = []
            while at < n:
                q = record.find('"', at)
                if q < 0:
                    part.append(record[at:])
                    at = n
                elif record.startswith('""', q):
                    part.append(record[at : q + 1])
                    at = q + 2
                elif q + 1 >= n or record[q + 1] == ",":
                    part.append(record[at:q])
                    at = q + 1
                    break
                else:
                    part.append(record[at : q + 1])
                    at = q + 1
            out.append("".join(part))
        else:
            end = record.find(",", at)
            end = n if end < 0 else end
            out.append(record[at:end])
            at = end
        if at >= n:
            return out
        at += 1
        if at == n:
            out.append("")
            return out
