"""Wall time, CPU time and peak memory of work on the driver, of a child process, and of Spark's stages."""

from __future__ import annotations

import os
import resource
import subprocess
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


@dataclass(frozen=True)
class Usage:
    wall: float
    cpu: float
    peak_kb: int

    @property
    def ratio(self) -> float:
        return self.cpu / self.wall if self.wall else 0.0


def measured(work: Callable[[], T]) -> tuple[T, Usage]:
    """What `work` returns and what it took in this process."""
    wall, cpu = time.perf_counter(), time.process_time()
    out = work()
    return out, Usage(time.perf_counter() - wall, time.process_time() - cpu, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)


def child(command: Sequence[str]) -> tuple[int, Usage]:
    """M1: the exit status of a command run on the driver, and what it took."""
    wall = time.perf_counter()
    process = subprocess.Popen(list(command))
    _, status, used = os.wait4(process.pid, 0)
    process.returncode = os.waitstatus_to_exitcode(status)
    return process.returncode, Usage(time.perf_counter() - wall, used.ru_utime + used.ru_stime, used.ru_maxrss)


def _memory(kb: int) -> str:
    if kb < 1024:
        return f"{kb} KB"
    return f"{kb // 1024} MB" if kb < 1 << 20 else "%.1f GB" % (kb / (1 << 20))


def _clock(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}  i.e.  {seconds:.1f} sec"


def usage_report(command: Sequence[str], usage: Usage, status: int) -> str:
    """What a command took, as tab-indented `label: value` lines; the labels are fixed, as logs are read by them."""
    pairs = [
        ("Command:", f'"{" ".join(command)}"'),
        ("MAX_rss:", _memory(usage.peak_kb)),
        ("CPU_time:", _clock(usage.cpu)),
        ("Wall_clock:", _clock(usage.wall)),
        ("Job_CPU:", "%.2f" % usage.ratio),
        ("Exit_status:", str(status)),
    ]
    return "".join(f"\t{label:<13}{value}\n" for label, value in pairs)


def write_report(folder: str | Path, text: str, most: int = 1023) -> Path:
    """K9: the report in the first file `0001.pstat`, `0002.pstat` ... of a folder of the driver that isn't there yet."""
    top = Path(folder)
    top.mkdir(parents=True, exist_ok=True)
    for i in range(1, most + 1):
        try:
            with open(top / f"{i:04d}.pstat", "x") as out:
                out.write(text)
        except FileExistsError:
            continue
        return top / f"{i:04d}.pstat"
    raise FileExistsError(f"{folder} has {most} reports")


_STAGES = "stage long, attempt int, name string, status string, tasks int, seconds double, cpu_seconds double, gc_seconds double, peak_memory long, spilled long, input_bytes long, shuffle_read long, shuffle_written long"


def stage_metrics(spark: SparkSession) -> DataFrame:
    """One row a stage that Spark still knows (`spark.ui.retainedStages`): run time, CPU time, peak execution memory and bytes moved, summed over its tasks."""
    rows = []
    kept = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    for i in range(kept.size()):
        s = kept.apply(i)
        rows.append(
            (s.stageId(), s.attemptId(), s.name(), s.status().toString(), s.numTasks(), s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.jvmGcTime() / 1e3)
            + (s.peakExecutionMemory(), s.memoryBytesSpilled() + s.diskBytesSpilled(), s.inputBytes(), s.shuffleReadBytes(), s.shuffleWriteBytes())
        )
    return spark.createDataFrame(rows, _STAGES)


def executor_peaks(spark: SparkSession) -> DataFrame:
    """`executor`, `peak_heap`, `peak_off_heap` (bytes) of every executor, the driver among them, as last reported."""
    rows = []
    kept = spark._jsc.sc().statusStore().executorList(False)
    for i in range(kept.size()):
        e = kept.apply(i)
        found = e.peakMemoryMetrics()
        value = (lambda name, m=found: int(m.get().getMetricValue(name)) if m.isDefined() else 0)
        rows.append((e.id(), value("JVMHeapMemory"), value("JVMOffHeapMemory")))
    return spark.createDataFrame(rows, "executor string, peak_heap long, peak_off_heap long")
