"""Jobs from a settings file: ``python -m graingrid.cli settings.json``.

Settings are ``job_type``, ``dataset`` (input_path, output_path), ``backend`` (or ``backends`` by stage or role), and the
job's options: ``options``, or for a pipeline its ``stages``. Any other name is an error.
"""

from __future__ import annotations

import argparse
import inspect
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators.model import backend_factory, check_health
from .plans import jobs, stages
from .session import session, ship
from .sources import jsonl

_KNOWN = {"job_type": str, "dataset": dict, "backend": dict, "backends": dict, "options": dict, "stages": list, "limit": int, "check_health": bool}
_DATASET = {"input_path": str, "output_path": str, "schema": str, "single_file": bool}
#: Jobs that call no model.
LOCAL = {"pe_rewrite_filter", "pe_rewrite_build_sft"}


def validate(config: dict[str, Any]) -> dict[str, Any]:
    """The settings, or a ValueError that names what is wrong with them."""
    job = config.get("job_type")
    if job not in jobs.JOBS:
        raise ValueError(f"job_type {job} is none of {', '.join(sorted(jobs.JOBS))}")
    for section, known in ((config, _KNOWN), (config.get("dataset") or {}, _DATASET)):
        for name, value in section.items():
            if name not in known:
                raise ValueError(f"unknown setting {name}; known are {', '.join(known)}")
            if not isinstance(value, known[name]) or known[name] is int and isinstance(value, bool):
                raise ValueError(f"setting {name} must be of type {known[name].__name__}")
    for name in ("input_path", "output_path"):
        if not (config.get("dataset") or {}).get(name):
            raise ValueError(f"dataset needs {name}")
    if "stages" in config:
        stages.check(job, config["stages"])
    if job not in LOCAL and not config.get("backend") and not config.get("backends"):
        raise ValueError(f"job {job} needs a backend")
    f = jobs.JOBS[job]
    accepted = inspect.signature(f).parameters
    if "stages" not in config and not any(p.kind is p.VAR_KEYWORD for p in accepted.values()):
        for name in config.get("options") or {}:
            if name not in accepted:
                raise ValueError(f"job {job} has no option {name}; its options are {', '.join(accepted)}")
    return config


def run(spark: SparkSession, config: dict[str, Any], env: dict[str, str] | None = None) -> DataFrame:
    """The job's rows, written to its output."""
    validate(config)
    jsonl.check_paths(config)
    data = config["dataset"]
    makes = {k: backend_factory(v, env) for k, v in (config.get("backends") or {}).items()}
    if config.get("backend"):
        makes[""] = backend_factory(config["backend"], env)
    if config.get("check_health") and (bad := [k or "backend" for k, ok in check_health(makes).items() if not ok]):
        raise RuntimeError(f"no healthy service: {', '.join(bad)}")
    rows = jsonl.require_rows(jsonl.read_jsonl(spark, data["input_path"], data.get("schema")), data["input_path"])
    if config.get("limit"):
        rows = rows.orderBy("_pos").limit(config["limit"])
    options = dict(config.get("options") or {})
    if "stages" in config:
        out = jobs.run(config["job_type"], rows, makes if len(makes) > 1 else makes.get(""), stages=config["stages"], output=data["output_path"])
    else:
        if media := makes.get("media"):
            options["media"] = media
        out = jobs.run(config["job_type"], rows, makes.get(""), **options)
        jsonl.write_jsonl(out, data["output_path"], single=data.get("single_file", False))
    return out


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="graingrid", description="Runs a job from a settings file.")
    args.add_argument("settings", help="JSON, or YAML where that library is there")
    args.add_argument("--master", help="Spark's master, if not the submitting command's")
    got = args.parse_args(argv)
    try:
        config = validate(jsonl.load_config(got.settings))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = session(got.master, f"graingrid {config['job_type']}")
    ship(spark)
    run(spark, config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
