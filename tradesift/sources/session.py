"""A web session for fetchers that land feeds: one visit to a site's front page brings the cookies its data pages want."""

from __future__ import annotations

import time
import urllib.request
from http.cookiejar import CookieJar


class Session:
    """``get`` warms up once, before the first page: the front page, then a pause. Any failure is the caller's to handle;
    a feed that cannot be fetched lands nothing and is tried in the next run."""

    def __init__(self, front: str, headers: dict[str, str] | None = None, pause: float = 1.0, timeout: float = 30.0):
        self.front, self.pause, self.timeout = front, pause, timeout
        self.headers = {"Accept": "application/json, text/plain, */*", "Referer": front} | (headers or {})
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(CookieJar()))
        self.warm = False

    def _open(self, url: str) -> bytes:
        with self.opener.open(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as reply:
            return reply.read()

    def get(self, url: str) -> bytes:
        if not self.warm:
            self._open(self.front)
            time.sleep(self.pause)
            self.warm = True
        return self._open(url)
