"""A writers' lease with a growing token, kept as small files beside what is written.

The holder's file ``_lock-<token>`` is followed by heartbeats, files ``_beat-<token>-<n>``;
none is ever written twice, so listing their names is enough.  A waiter that sees no new
heartbeat for a whole lease, by its own clock, makes the file of the next token, which
only one can, and holds the lease from then on.  Whoever was robbed finds its file gone
or a higher one and may not publish; states are named by the token they were made
under, so even a state that it publishes in between is older than the next holder's.
"""

from __future__ import annotations

import re
import threading
import time
import uuid

from palaver.sources.store import Store

#: Seconds without a heartbeat after which a holder counts as dead.
LEASE_S = 120


class Lost(RuntimeError):
    """The lease went to another writer."""


class Lease:
    """Holds the lease of a folder within ``with``; ``least`` is the highest token used there so far."""

    def __init__(self, store: Store, wait_s: float = 60, lease_s: float | None = None) -> None:
        self.store, self.wait_s, self.lease_s = store, wait_s, LEASE_S if lease_s is None else lease_s
        self.name, self.token, self.beats = uuid.uuid4().hex, 0, 0
        self._stop = threading.Event()

    def tokens(self, prefix: str = "_lock-") -> list[int]:
        """The tokens of files whose names begin so."""
        found = (re.match(rf"{prefix}(\d{{12}})(?!\d)[^/]*$", name) for name, _ in self.store.names())
        return sorted(int(m[1]) for m in found if m and not name_is_partial(m.string))

    def _beats(self, token: int) -> list[str]:
        """The heartbeats of a token, the last one last."""
        return sorted(name for name, _ in self.store.names() if name.startswith(f"_beat-{token:012d}-"))

    def _lock(self, token: int) -> str:
        return f"_lock-{token:012d}"

    def __enter__(self) -> Lease:
        until, seen, since = time.monotonic() + self.wait_s, None, 0.0
        while True:
            published = max(self.tokens("_meta-"), default=0)
            held = [t for t in self.tokens() if t >= published]
            if not held:
                wanted = published + 1
            else:
                beat = (held[-1], self._beats(held[-1])[-1:])
                if beat != seen:
                    seen, since = beat, time.monotonic()
                wanted = held[-1] + 1 if time.monotonic() - since >= self.lease_s else None
            if wanted and self._take(wanted):
                break
            if time.monotonic() > until:
                raise TimeoutError(f"another writer holds {self.store.root}/{self._lock(held[-1]) if held else ''}")
            time.sleep(min(0.2, self.lease_s / 8))
        for token in self.tokens():
            if token < self.token:
                self._clear(token)
        threading.Thread(target=self._renew, daemon=True).start()
        return self

    def _take(self, token: int) -> bool:
        if not self.store.create(self._lock(token), self.name):
            return False
        self.token = token
        # another may have taken and used this token since it was looked for
        if max(self.tokens("_meta-"), default=0) >= token or self.tokens()[-1] > token:
            self.store.delete(self._lock(token))
            return False
        return True

    def _clear(self, token: int) -> None:
        self.store.delete(self._lock(token))
        for name in self._beats(token):
            self.store.delete(name)

    def held(self) -> bool:
        return self.tokens()[-1:] == [self.token] and self.store.read(self._lock(self.token)) == self.name

    def check(self) -> None:
        """Raise if the lease was lost."""
        if not self.held():
            raise Lost(f"the lease {self.token} of {self.store.root} went to another writer")

    def beat(self) -> None:
        self.beats += 1
        self.store.create(f"_beat-{self.token:012d}-{self.beats:012d}", "")
        for name in self._beats(self.token)[:-2]:
            self.store.delete(name)

    def _renew(self) -> None:
        while not self._stop.wait(self.lease_s / 4):
            if not self.held():
                return
            self.beat()

    def stop(self) -> None:
        """No heartbeats from now on, as if this writer had died."""
        self._stop.set()

    def __exit__(self, _kind: object, error: BaseException | None, _trace: object) -> None:
        self.stop()
        if self.held():
            self._clear(self.token)
        elif isinstance(error, Exception) and not isinstance(error, Lost):
            # the new holder may have removed what this writer was reading
            raise Lost(f"the lease {self.token} of {self.store.root} went to another writer") from error


def name_is_partial(name: str) -> bool:
    """Whether a file is one that is still being written, beside its final name."""
    return re.search(r"\.[0-9a-f]{32}$", name) is not None
