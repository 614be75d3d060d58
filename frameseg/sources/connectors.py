"""Driver-side hooks for recordings on the web: a JSON interface with retries, ranged downloads, choice of streams. They are given the
function that fetches, so that nothing here opens a connection by itself."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import AV, BV, HOSTS, ILLEGAL, PAGE


def call(fetch: Callable[[str, dict], dict], url: str, params: dict, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The data of an answer. Failures of the fetch are tried again after 2, 4, ... seconds; an answer with a code other than 0 isn't."""
    for k in range(tries):
        try:
            answer = fetch(url, params)
        except OSError:
            if k + 1 == tries:
                raise
            sleep(2.0 * (k + 1))
            continue
        if answer.get("code"):
            raise RuntimeError(f"{url}: {answer.get('code')} {answer.get('message', '')}")
        return answer["data"]
    raise AssertionError


def download(fetch: Callable[[str, int], tuple[bool, Iterable[bytes]]], urls: list[str], out: Path, tries: int = 4) -> Path:
    """Appends to `out` what is missing of it. fetch(url, start) tells whether the answer begins at start (else at 0), and gives pieces;
    each try takes the next mirror."""
    for k in range(tries):
        start = out.stat().st_size if out.exists() else 0
        try:
            ranged, pieces = fetch(urls[k % len(urls)], start)
            with out.open("ab" if ranged else "wb") as f:
                for p in pieces:
                    f.write(p)
            return out
        except OSError:
            if k + 1 == tries:
                raise
    raise AssertionError


def resolve(fetch: Callable[[str, dict], dict], text: str, view_url: str, follow: Callable[[str], str] | None = None) -> tuple[str, int]:
    """Id and page (from 1) that an address or id names. A short link is followed, where follow(address) is given that returns where it leads; a number
    without an id is looked up; anything else is a ValueError."""
    text = text.strip()
    if follow and HOSTS[1] in text:
        text = follow(text if text.startswith("http") else f"https://{text}")
    page = int(m[1]) if (m := re.search(PAGE, text)) else 1
    if m := re.search(BV, text):
        return m[1], page
    if m := re.search(AV, text):
        return call(fetch, view_url, {"aid": m[1]})["bvid"], page
    raise ValueError(f"no recording's id in {text}")


def view(fetch: Callable[[str, dict], dict], url: str, vod: str) -> dict:
    """What is known of a recording: its title and pages."""
    return call(fetch, url, {"bvid": vod})


def streams(fetch: Callable[[str, dict], dict], url: str, vod: str, part: int) -> dict:
    """The audio and video streams of a part; an answer without any is a RuntimeError."""
    found = call(fetch, url, {"bvid": vod, "cid": part, "fnval": 16, "fourk": 1}).get("dash")
    if not found:
        raise RuntimeError("no dash streams in the answer; a cookie may be needed")
    return found


def best_of(listed: list[dict], video: bool = False) -> dict:
    """The stream with the largest bandwidth; of video streams that with the largest id, then the shortest codec name. The first one of equals."""
    return max(listed, key=(lambda s: (s["id"], -len(s["codecs"]))) if video else (lambda s: s["bandwidth"]))


def file_title(title: str, default: str = "video") -> str:
    """functions.text.safe_name for one title."""
    return re.sub(ILLEGAL, "_", title).strip("_")[:80] or default


def fetch_recording(ask: Callable[[str, dict], dict], get: Callable[[str, int], tuple[bool, Iterable[bytes]]], mux: Callable[[list[Path], Path], None], text: str, out_dir: Path, view_url: str, play_url: str, page: int | None = None, video: bool = False, follow: Callable[[str], str] | None = None) -> Path:
    """Downloads the best audio stream of a page, and with video its best video stream, has them joined by mux(parts, out) and returns that file. A page
    that the recording doesn't have is a ValueError."""
    vod, named = resolve(ask, text, view_url, follow)
    page, about = page or named, view(ask, view_url, vod)
    pages = about["pages"]
    if not 1 <= page <= len(pages):
        raise ValueError(f"page {page} isn't among the {len(pages)} of this recording")
    part = pages[page - 1]
    title = file_title(about["title"] if len(pages) == 1 else f"{about['title']}_p{page}_{part.get('part', '')}")
    found = streams(ask, play_url, vod, part["cid"])
    chosen = [("audio", best_of(found["audio"]))] + ([("video", best_of(found["video"], True))] if video else [])
    out_dir.mkdir(parents=True, exist_ok=True)
    parts = [download(get, [s["baseUrl"], *(s.get("backupUrl") or [])], out_dir / f"{vod}_p{page}.{kind}.m4s") for kind, s in chosen]
    out = out_dir / (title + (".mp4" if video else ".m4a"))
    mux(parts[::-1], out)
    for p in parts:
        p.unlink()
    return out


def best_audio(streams: str) -> Column:
    """Of an array of streams the first with the largest bandwidth."""
    return _first_best(streams, lambda s: F.struct(s["bandwidth"].alias("a"), F.lit(0).alias("b")))


def best_video(streams: str) -> Column:
    """The first with the largest id, then the shortest codec name."""
    return _first_best(streams, lambda s: F.struct(s["id"].alias("a"), (-F.length(s["codecs"])).alias("b")))


def _first_best(streams: str, rank) -> Column:
    ranked = F.transform(streams, lambda s, i: F.struct(rank(s).alias("r"), (-i).alias("i"), s.alias("s")))
    return F.array_max(F.transform(ranked, lambda x: F.struct(x["r"].alias("r"), x["i"].alias("i"))))["i"] * -1


def pick(streams: str, at: Column) -> Column:
    return F.get(streams, at)
