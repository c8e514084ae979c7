"""Command-line source: one JSON line per call into the landing folder, no retry.

Exit codes: 0 done, 2 invalid input, 3 the folder cannot be written, 4 anything else."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import uuid

from ..functions.text import TIMESTAMP


def event(args: argparse.Namespace, stdin) -> dict:
    if not args.session_id:
        raise ValueError("session_id")
    if not re.match(TIMESTAMP, args.timestamp):
        raise ValueError("timestamp")
    out = {"event_type": args.kind.replace("-", "_"), "session_id": args.session_id, "project_name": args.project_name, "current_working_directory": args.cwd, "timestamp": args.timestamp}
    if args.kind == "observation":
        data = json.load(stdin)
        if not isinstance(data, dict) or not args.hook_type:
            raise ValueError("data")
        out |= {"hook_type": args.hook_type, "data": data}
    return out


def main(argv: list[str] | None = None, stdin=sys.stdin) -> int:
    p = argparse.ArgumentParser(prog="loomspark-events", exit_on_error=False)
    p.add_argument("kind", choices=["session-start", "observation", "session-end"])
    for name in ("landing", "session-id", "project-name", "cwd", "timestamp"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--hook-type", default="")
    try:
        args = p.parse_args(argv)
        line = json.dumps(event(args, stdin), ensure_ascii=False, allow_nan=False)
    except (argparse.ArgumentError, SystemExit, ValueError) as e:
        print(f"invalid input: {e}", file=sys.stderr)
        return 2
    try:
        path = os.path.join(args.landing, f"{uuid.uuid4().hex}.json")
        with open(path + ".part", "w", encoding="utf-8") as f:
            f.write(line + "\n")
        os.rename(path + ".part", path)
    except OSError as e:
        print(f"cannot deliver: {e}", file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return 4
    print('{"dispatched":true}')
    return 0


if __name__ == "__main__":
    sys.exit(main())
