"""Ingestion jobs: first in, first out, one at a time; progress, cancelling between steps, resuming after a restart."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from graphloom.functions.columns import JOB_STAGES, stage_percent
from graphloom.operators.store import Files

#: Finished jobs that are remembered.
KEEP = 200


class Cancelled(RuntimeError):
    """The job was asked to stop."""


@dataclass
class Job:
    id: str
    project: str
    document_id: str
    operation: str  # create or upsert
    stage: str = "queued"
    done: int = 0
    total: int = 0
    created_at: float = 0.0
    finished_at: float | None = None
    error: str | None = None
    report: dict | None = None

    @property
    def percent(self) -> int:
        return stage_percent(self.stage, self.done, self.total)

    def line(self) -> str:
        """One line for agents."""
        what = f"{self.document_id} in {self.project}: {self.stage}"
        if self.error:
            return f"{what} ({self.error})"
        return what if self.finished_at else f"{what} {self.percent} %" + (f" ({self.done} of {self.total})" if self.total else "")


class Jobs:
    """work(job, step) does a job; step(stage, done, total) reports progress and raises Cancelled when the job is to stop.

    Waiting and running jobs stand as files in `folder`, so a new process takes them up again: what was a creation is
    then an upsert, for it may have been written already."""

    def __init__(self, spark, folder: str, work: Callable[[Job, Callable], dict | None]):
        self.spark, self.folder, self.work, self.files = spark, folder.rstrip("/"), work, Files(spark, folder)
        self.jobs: OrderedDict[str, Job] = OrderedDict()
        self.stopping: set[str] = set()
        self.lock = threading.Lock()
        self.worker = ThreadPoolExecutor(1, "ingestion")

    def submit(self, project: str, document_id: str, operation: str = "create", job_id: str | None = None) -> Job:
        job = Job(job_id or uuid.uuid4().hex, project, document_id, operation, created_at=time.time())
        self.files.replace(f"{self.folder}/{job.id}.json", json.dumps(asdict(job)))
        with self.lock:
            self.jobs[job.id] = job
            for old in [j for j in self.jobs.values() if j.finished_at][: max(0, len(self.jobs) - KEEP)]:
                del self.jobs[old.id]
        self.worker.submit(self._run, job)
        return job

    def resume(self) -> list[Job]:
        """Queue what an earlier process left, oldest first."""
        left = [json.loads(self.files.read(f"{self.folder}/{n}")) for n in self.files.names(self.folder) if n.endswith(".json")]
        return [self.submit(j["project"], j["document_id"], "upsert", j["id"]) for j in sorted(left, key=lambda j: j["created_at"]) if j["id"] not in self.jobs]

    def list(self, project: str | None = None) -> list[Job]:
        with self.lock:
            return [j for j in reversed(self.jobs.values()) if project in (None, j.project)]

    def get(self, job_id: str) -> Job | None:
        return self.jobs.get(job_id)

    def cancel(self, job_id: str) -> bool:
        """Whether the job was waiting or running; it stops at its next step, and its Spark jobs at once."""
        job = self.get(job_id)
        if job is None or job.finished_at:
            return False
        self.stopping.add(job_id)
        self.spark.sparkContext.cancelJobGroup(job_id)
        return True

    def close(self) -> None:
        self.worker.shutdown(wait=True)

    def _run(self, job: Job) -> None:
        def step(stage: str, done: int = 0, total: int = 0) -> None:
            if job.id in self.stopping:
                raise Cancelled("cancelled")
            if stage not in JOB_STAGES:
                raise ValueError(f"unknown stage {stage}")
            job.stage, job.done, job.total = stage, done, total

        try:
            step("queued")  # cancelled while it waited: it never starts
            self.spark.sparkContext.setJobGroup(job.id, job.line(), interruptOnCancel=True)
            job.report = self.work(job, step)
            job.stage = "done"
        except Exception as e:  # noqa: BLE001  a failing job is recorded, the next one goes on
            cancelled = job.id in self.stopping
            job.stage, job.error = ("cancelled", None) if cancelled else ("failed", str(e)[:300])
        finally:
            job.finished_at = time.time()
            self.stopping.discard(job.id)
            self.files.delete(f"{self.folder}/{job.id}.json")
