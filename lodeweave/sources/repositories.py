"""Where sources come from: configuration files, group listings of a code host, working copies."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from pathlib import Path

from lodeweave.sources.catalog import parse_db_url

MOST_PAGES = 500


def repositories_from(config: str | Path) -> list[dict]:
    """Entries of a repositories file: name, url or path, branch; names default to the last part of the address."""
    out = []
    for e in json.loads(Path(config).read_text()):
        e = {"url": e} if isinstance(e, str) else dict(e)
        where = e.get("url") or e.get("path") or ""
        e.setdefault("name", where.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
        out.append(e)
    return out


def databases_from(config: str | Path, env: dict | None = None) -> list[dict]:
    """Entries of a databases file; ``passwordEnv`` names the variable that holds the password."""
    env = os.environ if env is None else env
    out = []
    for e in json.loads(Path(config).read_text()):
        d = parse_db_url(e["url"]) if "url" in e else {"databases": [], **e}
        if e.get("passwordEnv"):
            d["password"] = env.get(e["passwordEnv"], "")
        out.append(d)
    return out


def group_listing(fetch: Callable[[int], list[dict]], active_since: str = "") -> list[dict]:
    """Repositories of a paged group listing: distinct by address, until a page is empty or brings nothing new.

    A listing that goes on after ``MOST_PAGES`` pages is an error, not a shorter list.
    """
    seen: dict[str, dict] = {}
    for page in range(1, MOST_PAGES + 1):
        rows = fetch(page)
        new = [r for r in rows if r.get("http_url_to_repo") and r["http_url_to_repo"] not in seen]
        for r in new:
            seen[r["http_url_to_repo"]] = {"name": r.get("path") or "", "url": r["http_url_to_repo"], "branch": r.get("default_branch") or "", "active": r.get("last_activity_at") or ""}
        if not rows or not new:
            break
    else:
        raise RuntimeError(f"the listing goes on after {MOST_PAGES} pages")
    return [r for r in seen.values() if not active_since or r["active"] >= active_since]


def working_copy(url_or_path: str, into: str | Path) -> Path:
    """A local path as it is; else a clone below ``into``, fetched and fast-forwarded if it is there already."""
    if Path(url_or_path).is_dir():
        return Path(url_or_path)
    target = Path(into) / url_or_path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")
    if (target / ".git").exists():
        subprocess.run(["git", "-C", str(target), "pull", "--ff-only", "-q"], check=True)
    else:
        subprocess.run(["git", "clone", "-q", "--", url_or_path, str(target)], check=True)
    return target


def each_source(sources: list[dict], ingest: Callable[[dict], int]) -> list[dict]:
    """Ingest source by source; a failure is counted and does not stop the others. A missing driver does."""
    out = []
    for s in sources:
        try:
            out.append({"name": s.get("name", ""), "ok": True, "written": ingest(s), "error": ""})
        except ImportError:
            raise
        except Exception as e:  # noqa: BLE001 - reported per source
            out.append({"name": s.get("name", ""), "ok": False, "written": 0, "error": f"{type(e).__name__}: {e}"})
    return out
