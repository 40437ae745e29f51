"""Ready-made views over a JVM's recorded events: 74 queries by name, category and kind.

Each view is one line of VIEWS: name; ``form`` where one record is shown as a
list; sources with aliases; columns as ``fn field = alias`` (no fn: plain);
group keys; and a tail of filters, order, limit and shares. HEADINGS has what a
report says above a view and its columns, and how it shows null and long cells.
The sets of columns, keys and filters, the headings and the formats are fixed values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..catalog import Catalog, QueryError
from ..functions.aggregates import NAMES
from ..operators.listing import show_events
from ..operators.query import Col, EventQuery, From, run
from ..render import form, table

# name | kind | sources | columns | keys | where | order | limit | shares
VIEWS = """
environment.active-recordings|table|ActiveRecording|last recordingStart, last recordingDuration, last name, last destination, last maxAge, last maxSize|id
environment.active-settings|table|ActiveSetting E, ActiveSetting T, ActiveSetting S, ActiveSetting P, ActiveSetting C, ActiveSetting U|E.id, last_batch E.value, last_batch T.value, last_batch S.value, last_batch P.value, last_batch C.value, last_batch U.value|id|E.name=enabled, T.name=threshold, S.name=stackTrace, P.name=period, C.name=cutoff, U.name=throttle|E.id
application.allocation-by-class|table|ObjectAllocationSample|objectClass = O, sum weight = W|O||W desc|25|W
application.allocation-by-thread|table|ObjectAllocationSample|eventThread = T, sum weight = W|T||W desc|25|W
application.allocation-by-site|table|ObjectAllocationSample|stackTrace.topFrame = S, sum weight = W|S||W desc|25|W
application.class-loaders|table|ClassLoaderStatistics|classLoader, last hiddenClassCount, last classCount = C|classLoader||C desc
jvm.class-modifications|table|RetransformClasses, RedefineClasses|duration, stackTrace.topApplicationFrame, eventType.label, classCount|redefinitionId||duration desc
jvm.compiler-configuration|form|CompilerConfiguration|last threadCount, last dynamicCompilerThreadCount, last tieredCompilation
jvm.compiler-statistics|form|CompilerStatistics|last compileCount, last peakTimeSpent, last totalTimeSpent, last bailoutCount, last osrCompileCount, last standardCompileCount, last osrBytesCompiled, last standardBytesCompiled, last nmethodsSize, last nmethodCodeSize
jvm.compiler-phases|table|CompilerPhase|phaseLevel = L, phase = P, avg duration, p95 duration, max duration, count *, sum duration = S|P||L asc, S desc
environment.container-configuration|form|ContainerConfiguration|last containerType, last cpuSlicePeriod, last cpuQuota, last cpuShares, last effectiveCpuCount, last memorySoftLimit, last memoryLimit, last swapMemoryLimit, last hostTotalMemory
environment.container-cpu-usage|form|ContainerCPUUsage|last cpuTime, last cpuUserTime, last cpuSystemTime
environment.container-memory-usage|form|ContainerMemoryUsage|last memoryFailCount, last memoryUsage, last swapMemoryUsage
environment.container-io-usage|form|ContainerIOUsage|last serviceRequests, last dataTransferred
environment.container-cpu-throttling|form|ContainerCPUThrottling|last cpuElapsedSlices, last cpuThrottledSlices, last cpuThrottledTime
application.contention-by-thread|table|JavaMonitorEnter|eventThread, count *, avg duration, p90 duration, max duration = M|eventThread||M
application.contention-by-class|table|JavaMonitorEnter|monitorClass, count *, avg duration, p90 duration, max duration = M|monitorClass||M
application.contention-by-site|table|JavaMonitorEnter|stackTrace = S, count *, avg duration, max duration = M|S||M
application.contention-by-address|table|JavaMonitorEnter|address, first monitorClass, unique *, max duration = M|monitorClass||M
environment.cpu-information|form|CPUInformation|cpu, sockets, cores, hwThreads, description
environment.cpu-load|form|CPULoad|min jvmUser, avg jvmUser, max jvmUser, min jvmSystem, avg jvmSystem, max jvmSystem, min machineTotal, avg machineTotal, max machineTotal
environment.cpu-load-samples|table|CPULoad|startTime, jvmUser, jvmSystem, machineTotal
environment.cpu-tsc|form|CPUTimeStampCounter|last fastTimeAutoEnabled, last fastTimeEnabled, last fastTimeFrequency, last osFrequency
jvm.deoptimizations-by-reason|table|Deoptimization|reason, count reason = C|reason||C desc
jvm.deoptimizations-by-site|table|Deoptimization|method, lineNumber, bci, count reason = C|method||C desc
environment.events-by-count|table|*|eventType.label = E, count * = C|E||C desc
environment.events-by-name|table|*|eventType.label = E, count * = C|E||E asc
environment.environment-variables|table|InitialEnvironmentVariable|last key = K, last value|key||K
application.exception-count|form|ExceptionStatistics|diff throwables
application.exception-by-type|table|JavaErrorThrow, JavaExceptionThrow|thrownClass = T, count thrownClass = C|T||C desc
application.exception-by-message|table|JavaErrorThrow, JavaExceptionThrow|message = M, count message = C|M||C desc
application.exception-by-site|table|JavaErrorThrow, JavaExceptionThrow|stackTrace.notInit = S, count startTime = C|S||C desc
application.file-reads-by-path|table|FileRead|path, count *, sum bytesRead = S|path||S desc
application.file-writes-by-path|table|FileWrite|path, count bytesWritten, sum bytesWritten = S|path||S desc
application.finalizers|table|FinalizerStatistics|finalizableClass, last_batch objects = O, last_batch totalFinalizersRun|finalizableClass||O desc
jvm.gc|table|GarbageCollection G, GCHeapSummary B, GCHeapSummary A, OldGarbageCollection O, YoungGarbageCollection Y|G.startTime, gcId, [Y/O].eventType.label, B.heapUsed, A.heapUsed, longestPause|gcId|B.when=Before GC, A.when=After GC|G.startTime
jvm.gc-concurrent-phases|table|GCPhaseConcurrent, GCPhaseConcurrentLevel1|name, avg duration, p95 duration, max duration, count *, sum duration = S|name||S
jvm.gc-configuration|form|GCConfiguration|last youngCollector, last oldCollector, last parallelGCThreads, last concurrentGCThreads, last usesDynamicGCThreads, last isExplicitGCConcurrent, last isExplicitGCDisabled, last pauseTarget, last gcTimeRatio
jvm.gc-references|table|GCReferenceStatistics S, GCReferenceStatistics W, GCReferenceStatistics P, GCReferenceStatistics F, GCReferenceStatistics G|G.startTime, G.gcId, S.count, W.count, P.count, F.count, sum G.count|gcId|S.type=Soft reference, W.type=Weak reference, P.type=Phantom reference, F.type=Final reference|G.gcId asc
jvm.gc-pause-phases|table|GCPhasePause, GCPhasePauseLevel1, GCPhasePauseLevel2, GCPhasePauseLevel3, GCPhasePauseLevel4|eventType.label = T, name, avg duration, p95 duration, max duration, count *, sum duration = S|name||T asc, S
jvm.gc-pauses|form|GCPhasePause|sum duration, count duration, min duration, median duration, avg duration, p90 duration, p95 duration, p99 duration, p999 duration, max duration
jvm.gc-allocation-trigger|table|AllocationRequiringGC|stackTrace.topApplicationFrame = S, count *, sum size|S
jvm.gc-cpu-time|form|GCCPUTime|sum userTime, sum systemTime, sum realTime, diff startTime, count *
jvm.heap-configuration|form|GCHeapConfiguration|last initialSize, last minSize, last maxSize, last usesCompressedOops, last compressedOopsMode
application.hot-methods|table|ExecutionSample|stackTrace.topFrame = T, count *, count * = N|T|||25|N
environment.jvm-flags|table|IntFlag, UnsignedIntFlag, BooleanFlag, LongFlag, UnsignedLongFlag, DoubleFlag, StringFlag, IntFlagChanged, UnsignedIntFlagChanged, BooleanFlagChanged, LongFlagChanged, UnsignedLongFlagChanged, DoubleFlagChanged, StringFlagChanged|name = N, last value|name||name asc
jvm.jvm-information|form|JVMInformation|last pid, last jvmStartTime, last jvmName, last jvmVersion, last jvmArguments, last javaArguments
application.latencies-by-type|table|JavaMonitorWait, JavaMonitorEnter, ThreadPark, ThreadSleep, SocketRead, SocketWrite, FileWrite, FileRead|eventType.label = T, count *, avg duration, p99 duration, max duration, sum duration|T
application.memory-leaks-by-class|table|OldObjectSample|last_batch allocationTime = A, last_batch object.type, last_batch objectAge, last_batch lastKnownHeapUsage|object.type||A
application.memory-leaks-by-site|table|OldObjectSample|last_batch allocationTime = A, last_batch stackTrace.topApplicationFrame, last_batch objectAge, last_batch lastKnownHeapUsage|stackTrace.topApplicationFrame||A
application.modules|table|ModuleRequire|last source.name = S|source.name||S
application.monitor-inflation|table|jdk.JavaMonitorInflate|stackTrace, monitorClass, count *, sum duration = S|stackTrace, monitorClass||S
environment.native-libraries|table|NativeLibrary|name = N, baseAddress, topAddress|name||N
jvm.native-memory-committed|table|NativeMemoryUsage|type, first committed, avg committed, last committed, max committed = M|type||M desc
jvm.native-memory-reserved|table|NativeMemoryUsage|type, first reserved, avg reserved, last reserved, max reserved = M|type||M desc
application.native-methods|table|NativeMethodSample|stackTrace.topFrame = T, count *, count * = N|T||||N
environment.network-utilization|table|NetworkUtilization|networkInterface, avg readRate, max readRate, avg writeRate, max writeRate|networkInterface
application.object-statistics|table|ObjectCountAfterGC, ObjectCount|last_batch objectClass, last_batch count, last_batch totalSize = Z, diff totalSize|objectClass||Z desc
application.pinned-threads|table|VirtualThreadPinned|stackTrace.topApplicationFrame = S, count *, max duration, sum duration = T|S||T desc
application.thread-count|table|JavaThreadStatistics|*
environment.recording|form|*|count startTime, first startTime, last startTime, diff startTime, last jdk.Shutdown.reason
jvm.safepoints|table|SafepointBegin B, SafepointEnd E, SafepointCleanup C, SafepointStateSynchronization S|B.startTime, diff [B/E].startTime, S.duration, C.duration, jniCriticalThreadCount, totalThreadCount|safepointId||B.startTime
jvm.longest-compilations|table|Compilation|startTime, duration = D, method, compileLevel, succeded|||D|25
application.longest-class-loading|table|ClassLoad|startTime, loadedClass, duration = D|||D desc|25
environment.system-properties|table|InitialSystemProperty|key = K, value|key||K
application.socket-writes-by-host|table|SocketWrite|host, count *, sum bytesWritten = S|host||S desc
application.socket-reads-by-host|table|SocketRead|host, count *, sum bytesRead = S|host||S desc
environment.system-information|form|CPUInformation, PhysicalMemory, OSInformation|last totalSize, last osVersion, last cpu, last cores, last hwThreads, last sockets, last description
environment.system-processes|table|SystemProcess|first startTime, last startTime, first pid, first commandLine|pid
jvm.tlabs|form|ObjectAllocationInNewTLAB I, ObjectAllocationOutsideTLAB O|count I.tlabSize, min I.tlabSize, avg I.tlabSize, max I.tlabSize, sum I.tlabSize, count O.allocationSize, min O.allocationSize, avg O.allocationSize, max O.allocationSize, sum O.allocationSize
application.thread-allocation|table|ThreadAllocationStatistics|thread, last allocated, last allocated = A|thread||A desc||A
application.thread-cpu-load|table|ThreadCPULoad|eventThread = E, last system, last user = U|E||U desc
application.thread-start|table|ThreadStart S, ThreadEnd E|S.startTime, S.stackTrace, eventThread, diff startTime = D|eventThread||D desc
jvm.vm-operations|table|jdk.ExecuteVMOperation|operation, avg duration, max duration, count *, sum duration|operation
"""

# name | title | headers (none: labels of the fields) | formats, where any
HEADINGS = """
active-recordings|Active Recordings|Start, Duration, Name, Destination, Max Age, Max Size|none, none, none, cell-height:5, none, none
active-settings|Active Settings|Event Type, Enabled, Threshold, Stack Trace, Period, Cutoff, Throttle|none, missing:, missing:, missing:, missing:, missing:, missing:
allocation-by-class|Allocation by Class|Object Type, Allocation Pressure
allocation-by-thread|Allocation by Thread|Thread, Allocation Pressure
allocation-by-site|Allocation by Site|Method, Allocation Pressure
class-loaders|Class Loaders||missing:null-bootstrap, none, none
class-modifications|Class Modifications|Time, Requested By, Operation, Classes
compiler-configuration|Compiler Configuration
compiler-statistics|Compiler Statistics
compiler-phases|Concurrent Compiler Phases|Level, Phase, Average, P95, Longest, Count, Total
container-configuration|Container Configuration
container-cpu-usage|Container CPU Usage
container-memory-usage|Container Memory Usage
container-io-usage|Container I/O Usage
container-cpu-throttling|Container CPU Throttling
contention-by-thread|Contention by Thread|Thread, Count, Avg, P90, Max.
contention-by-class|Contention by Lock Class|Lock Class, Count, Avg., P90, Max.
contention-by-site|Contention by Site|StackTrace, Count, Avg., Max.
contention-by-address|Contention by Monitor Address|Monitor Address, Class, Threads, Max Duration
cpu-information|CPU Information
cpu-load|CPU Load Statistics|JVM User (Minimum), JVM User (Average), JVM User (Maximum), JVM System (Minimum), JVM System (Average), JVM System (Maximum), Machine Total (Minimum), Machine Total (Average), Machine Total (Maximum)
cpu-load-samples|CPU Load
cpu-tsc|CPU Time Stamp Counter
deoptimizations-by-reason|Deoptimization by Reason
deoptimizations-by-site|Deoptimization by Site
events-by-count|Event Types by Count
events-by-name|Event Types by Name
environment-variables|Environment Variables||none, cell-height:20
exception-count|Exception Statistics|Exceptions Thrown
exception-by-type|Exceptions by Type|Class, Count
exception-by-message|Exceptions by Message|Message, Count
exception-by-site|Exceptions by Site|Method, Count
file-reads-by-path|File Reads by Path|Path, Reads, Total Read|cell-height:5, none, none
file-writes-by-path|File Writes by Path|Path, Writes, Total Written|cell-height:5, none, none
finalizers|Finalizers
gc|Garbage Collections|Start, GC ID, Type, Heap Before GC, Heap After GC, Longest Pause|none, none, missing:Unknown, none, none, none
gc-concurrent-phases|Concurrent GC Phases|Name, Average, P95, Longest, Count, Total
gc-configuration|GC Configuration|Young GC, Old GC, Parallel GC Threads, Concurrent GC Threads, Dynamic GC Threads, Concurrent Explicit GC, Disable Explicit GC, Pause Target, GC Time Ratio
gc-references|GC References|Time, GC ID, Soft Ref., Weak Ref., Phantom Ref., Final Ref., Total Count
gc-pause-phases|GC Pause Phases|Type, Name, Average, P95, Longest, Count, Total
gc-pauses|GC Pauses|Total Pause Time, Number of Pauses, Minimum Pause Time, Median Pause Time, Average Pause Time, P90 Pause Time, P95 Pause Time, P99 Pause Time, P99.9% Pause Time, Maximum Pause Time
gc-allocation-trigger|GC Allocation Trigger|Trigger Method (Non-JDK), Count, Total Requested
gc-cpu-time|GC CPU Time|GC User Time, GC System Time, GC Wall Clock Time, Total Time, GC Count
heap-configuration|Heap Configuration
hot-methods|Java Methods that Executes the Most|Method, Samples, Percent
jvm-flags|Command Line Flags
jvm-information|JVM Information|PID, VM Start, Name, Version, VM Arguments, Program Arguments
latencies-by-type|Latencies by Type|Event Type, Count, Average, P 99, Longest, Total
memory-leaks-by-class|Memory Leak Candidates by Class|Alloc. Time, Object Class, Object Age, Heap Usage
memory-leaks-by-site|Memory Leak Candidates by Site|Alloc. Time, Application Method, Object Age, Heap Usage
modules|Modules
monitor-inflation|Monitor Inflation
native-libraries|Native Libraries||cell-height:2, none, none
native-memory-committed|Native Memory Committed|Memory Type, First Observed, Average, Last Observed, Maximum
native-memory-reserved|Native Memory Reserved|Memory Type, First Observed, Average, Last Observed, Maximum
native-methods|Waiting or Executing Native Methods|Method, Samples, Percent
network-utilization|Network Utilization
object-statistics|Objects Occupying More than 1%|Class, Count, Heap Space, Increase
pinned-threads|Pinned Virtual Threads|Method, Pinned Count, Longest Pinning, Total Time Pinned
thread-count|Java Thread Statistics
recording|Recording Information|Event Count, First Recorded Event, Last Recorded Event, Length of Recorded Events, Dump Reason
safepoints|Safepoints|Start Time, Duration, State Syncronization, Cleanup, JNI Critical Threads, Total Threads
longest-compilations|Longest Compilations
longest-class-loading|Longest Class Loading|Time, Loaded Class, Load Time
system-properties|System Properties at Startup||none, cell-height:25
socket-writes-by-host|Socket Writes by Host|Host, Writes, Total Written|cell-height:2, none, none
socket-reads-by-host|Socket Reads by Host|Host, Reads, Total Read|cell-height:2, none, none
system-information|System Information|Total Physical Memory Size, OS Version, CPU Type, Number of Cores, Number of Hardware Threads, Number of Sockets, CPU Description
system-processes|System Processes|First Observed, Last Observed, PID, Command Line
tlabs|Thread Local Allocation Buffers|Inside TLAB Count, Inside TLAB Minimum Size, Inside TLAB Average Size, Inside TLAB Maximum Size, Inside TLAB Total Allocation, Outside TLAB Count, OutSide TLAB Minimum Size, Outside TLAB Average Size, Outside TLAB Maximum Size, Outside TLAB Total Allocation
thread-allocation|Thread Allocation Statistics|Thread, Allocated, Percentage
thread-cpu-load|Thread CPU Load|Thread, System, User
thread-start|Platform Thread Start by Method|Start Time, Stack Trace, Thread, Duration
vm-operations|VM Operations|VM Operation, Average Duration, Longest Duration, Count, Total Duration
"""


@dataclass(frozen=True)
class View:
    category: str
    name: str
    query: EventQuery
    title: str = ""


def _items(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _column(text: str, shares: list[str]) -> Col:
    words, _, alias = (x.strip() for x in text.partition("="))
    fn, _, field = words.rpartition(" ")
    if fn and fn not in NAMES:
        raise QueryError(f"no aggregate is named {fn}")
    return Col(re.sub(r"/(?=\w+\])", "|", field), fn or "value", alias or None, share=alias in shares)


def _headed(columns: list[Col], headers: list[str], formats: list[str]) -> list[Col]:
    """The columns with their headers, texts for null and cell heights."""
    out = []
    for i, c in enumerate(columns):
        how, _, value = (formats[i] if formats else "none").partition(":")
        more: dict = {"label": headers[i]} if headers else {}
        if how == "missing":
            more["missing"] = value
        elif how == "cell-height":
            more["height"] = int(value)
        out.append(replace(c, **more))
    return out


def _headings() -> dict[str, list[str]]:
    lines = (x.split("|") + [""] * 2 for x in HEADINGS.strip().splitlines())
    return {x[0]: x[1:4] for x in lines}


def _view(line: str, headings: dict[str, list[str]]) -> View:
    name, kind, sources, columns, keys, where, order, limit, shares = (line.split("|") + [""] * 6)[:9]
    category, _, short = name.partition(".")
    frm = [From(*x.split()) for x in _items(sources)]
    shared = _items(shares)
    title, headers, formats = headings[short]
    query = EventQuery(
        frm,
        None if columns == "*" else _headed([_column(c, shared) for c in _items(columns)], _items(headers), _items(formats)),
        where=[tuple(x.split("=")) for x in _items(where)],  # type: ignore[misc]
        group=_items(keys),
        order=[tuple(x.split()) if " " in x else x for x in _items(order)],  # type: ignore[misc]
        limit=int(limit) if limit else None,
        form=kind == "form",
    )
    return View(category, short, query, title)


CATALOG: dict[str, View] = {v.name: v for v in (_view(line, _headings()) for line in VIEWS.strip().splitlines())}


def view(catalog: Catalog, name: str) -> DataFrame:
    """The named view, the listing ``types``, or all fields of the event type of that name; letter case doesn't count for views."""
    if name.lower() == "types":
        return show_events(catalog)
    found = CATALOG.get(name.lower())
    return run(catalog, found.query if found else EventQuery([From(name)]))


def report(catalog: Catalog, name: str, **how) -> str:
    """A view as text under its title: a form or a table, which ``how`` shapes."""
    found = CATALOG.get(name.lower())
    if found and found.query.form:
        return form(view(catalog, name), title=found.title)
    title = found.title if found else None if name.lower() == "types" else catalog.find(name)[0].label
    return table(view(catalog, name), title=title, **how)


def all_events(catalog: Catalog) -> dict[str, DataFrame]:
    """All fields of each event type, by the type's name."""
    return {name: run(catalog, EventQuery([From(name)])) for name in sorted(catalog.types)}


def all_views(catalog: Catalog) -> dict[str, DataFrame | QueryError]:
    """Every view; a recording without its event types gives the error in its place."""
    out: dict[str, DataFrame | QueryError] = {}
    for name, v in CATALOG.items():
        try:
            out[name] = run(catalog, v.query)
        except QueryError as e:
            out[name] = e
    return out
