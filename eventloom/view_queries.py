"""Views over event types made of the supplied events, each with the SQL that gives the same rows.

Every type takes the events of one kind; its fields are expressions that both
engines read. Columns are named as the views name them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, EventType
from .plans.views import view

D = "CAST(floor(value * 1000000) AS BIGINT)"  # nanoseconds
SPANS = {"duration", "longestPause", "userTime", "systemTime", "realTime"}
_PHASE = {"name": "'p' || (user_id % 5)", "duration": D}
_THROWN = {"thrownClass": "'E' || (user_id % 7)", "message": "'m' || (user_id % 12)"}
_COUNTED = {"objectClass": "'O' || (user_id % 5)", "count": "event_id % 90", "totalSize": "event_id * 16"}
_PAIR = {"key": "'k' || (user_id % 20)", "value": "'v' || event_id"}
TYPES: dict[str, tuple[str, dict[str, str]]] = {
    "FileRead": ("click", {"duration": D, "path": "'/in/' || (user_id % 7)", "bytesRead": "event_id % 1000"}),
    "FileWrite": ("view", {"duration": D, "path": "'/out/' || (user_id % 5)", "bytesWritten": "event_id % 500"}),
    "SocketRead": ("error", {"duration": D, "host": "'h' || (user_id % 9)", "bytesRead": "event_id % 300"}),
    "SocketWrite": ("purchase", {"duration": D, "host": "'h' || (user_id % 9)", "bytesWritten": "event_id % 200"}),
    "JavaMonitorEnter": ("signup", {"duration": D, "eventThread": "'t' || (user_id % 11)", "monitorClass": "'C' || (user_id % 4)", "address": "user_id % 13"}),
    "JavaMonitorWait": ("click", {"duration": D}), "ThreadPark": ("view", {"duration": D}), "ThreadSleep": ("error", {"duration": D}),
    "Deoptimization": ("error", {"reason": "'r' || (user_id % 6)", "method": "'m' || (user_id % 8)", "lineNumber": "event_id % 50", "bci": "event_id % 70"}),
    "JavaErrorThrow": ("error", _THROWN), "JavaExceptionThrow": ("click", _THROWN),
    "GarbageCollection": ("signup", {"gcId": "user_id", "longestPause": D}),
    "GCHeapSummary": ("view", {"gcId": "user_id", "when": "CASE WHEN event_id % 2 = 0 THEN 'Before GC' ELSE 'After GC' END", "heapUsed": "event_id * 1000"}),
    "OldGarbageCollection": ("error", {"gcId": "user_id"}), "YoungGarbageCollection": ("purchase", {"gcId": "user_id"}),
    "GCReferenceStatistics": ("view", {"gcId": "user_id % 40", "type": "CASE event_id % 4 WHEN 0 THEN 'Soft reference' WHEN 1 THEN 'Weak reference' WHEN 2 THEN 'Phantom reference' ELSE 'Final reference' END", "count": "event_id % 100"}),
    "GCPhasePause": ("click", _PHASE), "GCPhasePauseLevel1": ("view", _PHASE), "GCPhasePauseLevel2": ("error", _PHASE), "GCPhasePauseLevel3": ("purchase", _PHASE), "GCPhasePauseLevel4": ("signup", _PHASE),
    "GCPhaseConcurrent": ("purchase", _PHASE), "GCPhaseConcurrentLevel1": ("signup", _PHASE),
    "GCCPUTime": ("error", {"userTime": D, "systemTime": f"{D} + 7", "realTime": f"{D} * 2"}),
    "CPULoad": ("view", {"jvmUser": "value / 1000", "jvmSystem": "value / 2000", "machineTotal": "value / 500"}),
    "NetworkUtilization": ("purchase", {"networkInterface": "'eth' || (user_id % 3)", "readRate": "event_id % 10000", "writeRate": "event_id % 7000"}),
    "NativeMemoryUsage": ("signup", {"type": "'T' || (user_id % 6)", "committed": "event_id * 10", "reserved": "event_id * 20"}),
    "ExecuteVMOperation": ("click", {"operation": "'o' || (user_id % 8)", "duration": D}),
    "ObjectAllocationInNewTLAB": ("click", {"tlabSize": "event_id % 4096"}), "ObjectAllocationOutsideTLAB": ("view", {"allocationSize": "event_id % 5000"}),
    "Compilation": ("error", {"duration": D, "method": "'m' || (user_id % 8)", "compileLevel": "user_id % 4", "succeded": "event_id % 2 = 0"}),
    "ClassLoad": ("purchase", {"loadedClass": "'c.L' || user_id", "duration": D}),
    "SystemProcess": ("view", {"pid": "user_id", "commandLine": "'run ' || event_id"}),
    "ExceptionStatistics": ("click", {"throwables": "event_id"}),
    "FinalizerStatistics": ("signup", {"finalizableClass": "'F' || (user_id % 5)", "objects": "event_id % 30", "totalFinalizersRun": "event_id"}),
    "ObjectCount": ("error", _COUNTED), "ObjectCountAfterGC": ("view", _COUNTED),
    "ThreadAllocationStatistics": ("view", {"thread": "'t' || (user_id % 11)", "allocated": "event_id * 8"}),
    "ObjectAllocationSample": ("click", {"objectClass": "'O' || (user_id % 9)", "eventThread": "'t' || (user_id % 11)", "weight": "event_id % 2048"}),
    "ThreadCPULoad": ("error", {"eventThread": "'t' || (user_id % 11)", "system": "value / 1000", "user": "value / 500"}),
    "InitialEnvironmentVariable": ("signup", _PAIR), "InitialSystemProperty": ("purchase", _PAIR),
    "ClassLoaderStatistics": ("view", {"classLoader": "'l' || (user_id % 6)", "hiddenClassCount": "event_id % 10", "classCount": "event_id % 300"}),
    "SafepointBegin": ("click", {"safepointId": "user_id", "jniCriticalThreadCount": "event_id % 3", "totalThreadCount": "event_id % 60"}),
    "SafepointEnd": ("view", {"safepointId": "user_id"}), "SafepointCleanup": ("error", {"safepointId": "user_id", "duration": D}), "SafepointStateSynchronization": ("purchase", {"safepointId": "user_id", "duration": D}),
    "CompilerPhase": ("signup", {"phaseLevel": "user_id % 3", "phase": "'p' || (user_id % 6)", "duration": D}),
    "NativeLibrary": ("click", {"name": "'lib' || (user_id % 15)", "baseAddress": "event_id * 4096", "topAddress": "event_id * 4096 + 999"}),
    "JavaThreadStatistics": ("error", {"activeCount": "event_id % 40", "peakCount": "event_id % 80"}),
    "Shutdown": ("signup", {"reason": "'end ' || event_id"}),
    "ActiveSetting": ("view", {"id": "user_id % 10", "name": "CASE event_id % 6 WHEN 0 THEN 'enabled' WHEN 1 THEN 'threshold' WHEN 2 THEN 'stackTrace' WHEN 3 THEN 'period' WHEN 4 THEN 'cutoff' ELSE 'throttle' END", "value": "'s' || event_id"}),
    "VirtualThreadPinned": ("click", {"duration": D}),
    "CompilerConfiguration": ("click", {"threadCount": "event_id", "dynamicCompilerThreadCount": "user_id", "tieredCompilation": "event_id % 2 = 0"}),
    "ContainerCPUUsage": ("view", {"cpuTime": "event_id", "cpuUserTime": "user_id", "cpuSystemTime": "event_id + user_id"}),
    "ContainerMemoryUsage": ("error", {"memoryFailCount": "event_id", "memoryUsage": "user_id", "swapMemoryUsage": "event_id + user_id"}),
    "ContainerIOUsage": ("purchase", {"serviceRequests": "event_id", "dataTransferred": "user_id"}),
    "ContainerCPUThrottling": ("signup", {"cpuElapsedSlices": "event_id", "cpuThrottledSlices": "user_id", "cpuThrottledTime": "event_id + user_id"}),
    "CPUTimeStampCounter": ("click", {"fastTimeAutoEnabled": "event_id % 2 = 0", "fastTimeEnabled": "event_id % 3 = 0", "fastTimeFrequency": "event_id", "osFrequency": "user_id"}),
    "GCHeapConfiguration": ("view", {"initialSize": "event_id", "minSize": "user_id", "maxSize": "event_id * 3", "usesCompressedOops": "event_id % 2 = 0", "compressedOopsMode": "'mode ' || user_id"}),
    "JVMInformation": ("error", {"pid": "user_id", "jvmStartTime": "event_id", "jvmName": "'vm ' || user_id", "jvmVersion": "'v' || event_id", "jvmArguments": "'-a ' || user_id", "javaArguments": "'-b ' || event_id"}),
    "CPUInformation": ("click", {"cpu": "'cpu ' || user_id", "sockets": "user_id % 3", "cores": "event_id % 64", "hwThreads": "event_id % 128", "description": "'d ' || event_id"}),
    "PhysicalMemory": ("view", {"totalSize": "event_id * 1024"}), "OSInformation": ("error", {"osVersion": "'os ' || event_id"}),
}


def catalog(spark: SparkSession, sf_dir: str, names: list[str]) -> Catalog:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = Catalog()
    for name in names:
        kind, fields = TYPES[name]
        columns = [F.expr(e).alias(f, metadata={"kind": "timespan"} if f in SPANS else {}) for f, e in fields.items()]
        d = events.where(F.col("event_type") == kind).select(F.col("event_id").alias("seq"), F.col("ts").alias("startTime"), *columns)
        c.add(EventType(f"jdk.{name}", d, ("startTime", "seq"), "startTime"))
    return c


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, types: str, sql: str) -> None:
    """Registers a view over the types named; ``sql`` reads them as tables."""
    names = types.split()
    tables = []
    for n in names:
        kind, fields = TYPES[n]
        tables.append(f'{n} AS (SELECT event_id AS seq, ts AS startTime, {", ".join(f"""{e} AS "{f}" """.strip() for f, e in fields.items())} FROM events WHERE event_type = \'{kind}\')')
    key = "view_" + name.replace("-", "_")
    QUERIES[key] = lambda spark, sf_dir: view(catalog(spark, sf_dir, names), name)
    SQL[key] = f"WITH {', '.join(tables)} {sql}"


O = "(startTime, seq)"  # noqa: E741


def _last(x: str) -> str:
    return f"arg_max_null({x}, {O})"


def _span_avg(x: str = "duration") -> str:
    return f"(sum({x} // 1000000000) // count({x}) * 1000000000 + sum({x} % 1000000000) // count({x}))::BIGINT"


def _quantile(p: float, x: str = "duration") -> str:
    d = f"((count({x}) + 1) * {p}::DOUBLE)"
    at = lambda k: f"list_sort(list({x}))[floor({d})::BIGINT + {k}]"
    return f"trunc(CASE WHEN floor({d}) < 1 THEN min({x}) WHEN floor({d}) >= count({x}) THEN max({x}) ELSE {at(0)} + ({d} - floor({d}) + 1) * ({at(1)} - {at(0)}) END)::BIGINT"


def _union(types: str, columns: str) -> str:
    """The rows of several types, with the type's label."""
    label = lambda n: "".join(" " + ch if ch.isupper() and i and not n[i - 1].isupper() else ch for i, ch in enumerate(n))
    return " UNION ALL ".join(f"SELECT seq, startTime, '{label(n)}' AS label, {columns} FROM {n}" for n in types.split())


_add("file-reads-by-path", "FileRead", "SELECT path, count(*) AS count_all, sum(bytesRead)::BIGINT AS S FROM FileRead GROUP BY path")
_add("file-writes-by-path", "FileWrite", 'SELECT path, count(*) AS "count_bytesWritten", sum(bytesWritten)::BIGINT AS S FROM FileWrite GROUP BY path')
_add("socket-reads-by-host", "SocketRead", "SELECT host, count(*) AS count_all, sum(bytesRead)::BIGINT AS S FROM SocketRead GROUP BY host")
_add("socket-writes-by-host", "SocketWrite", "SELECT host, count(*) AS count_all, sum(bytesWritten)::BIGINT AS S FROM SocketWrite GROUP BY host")
for _name, _key in (("contention-by-thread", "eventThread"), ("contention-by-class", "monitorClass")):
    _add(_name, "JavaMonitorEnter", f'SELECT "{_key}", count(*) AS count_all, {_span_avg()} AS avg_duration, {_quantile(0.9)} AS p90_duration, max(duration) AS M FROM JavaMonitorEnter GROUP BY 1')
_add("contention-by-address", "JavaMonitorEnter", f'SELECT arg_max(address, {O}) AS address, arg_min_null(monitorClass, {O}) AS "first_monitorClass", count(DISTINCT startTime) AS unique_all, max(duration) AS M FROM JavaMonitorEnter GROUP BY monitorClass')
_add("deoptimizations-by-reason", "Deoptimization", "SELECT reason, count(*) AS C FROM Deoptimization GROUP BY reason")
_add("deoptimizations-by-site", "Deoptimization", f'SELECT method, arg_max(lineNumber, {O}) AS "lineNumber", arg_max(bci, {O}) AS bci, count(*) AS C FROM Deoptimization GROUP BY method')
for _name, _key, _as in (("exception-by-type", "thrownClass", "T"), ("exception-by-message", "message", "M")):
    _add(_name, "JavaErrorThrow JavaExceptionThrow", f"SELECT {_key} AS {_as}, count(*) AS C FROM ({_union('JavaErrorThrow JavaExceptionThrow', _key)}) GROUP BY 1")
_LATENT = "JavaMonitorWait JavaMonitorEnter ThreadPark ThreadSleep SocketRead SocketWrite FileWrite FileRead"
_add("latencies-by-type", _LATENT, f"SELECT label AS T, count(*) AS count_all, {_span_avg()} AS avg_duration, {_quantile(0.99)} AS p99_duration, max(duration) AS max_duration, sum(duration)::BIGINT AS sum_duration FROM ({_union(_LATENT, 'duration')}) GROUP BY 1")
_GC = """SELECT gcId, startTime, seq, 'G' AS a, longestPause AS p, NULL AS h, NULL AS label FROM GarbageCollection UNION ALL SELECT gcId, startTime, seq, "when", NULL, heapUsed, NULL FROM GCHeapSummary
UNION ALL SELECT gcId, startTime, seq, 'T', NULL, NULL, 'Old Garbage Collection' FROM OldGarbageCollection UNION ALL SELECT gcId, startTime, seq, 'T', NULL, NULL, 'Young Garbage Collection' FROM YoungGarbageCollection"""
_add("gc", "GarbageCollection GCHeapSummary OldGarbageCollection YoungGarbageCollection", f"""SELECT arg_max(startTime, {O}) FILTER (a = 'G') AS "G_startTime", gcId AS "gcId", arg_max(label, {O}) AS "Y_O_eventType_label", arg_max(h, {O}) FILTER (a = 'Before GC') AS "B_heapUsed", arg_max(h, {O}) FILTER (a = 'After GC') AS "A_heapUsed", arg_max(p, {O}) AS "longestPause" FROM ({_GC}) GROUP BY gcId""")
_kind = lambda k: f"""arg_max("count", {O}) FILTER ("type" = '{k} reference')"""
_add("gc-references", "GCReferenceStatistics", f"""SELECT arg_max(startTime, {O}) AS "G_startTime", gcId AS "G_gcId", {_kind('Soft')} AS "S_count", {_kind('Weak')} AS "W_count", {_kind('Phantom')} AS "P_count", {_kind('Final')} AS "F_count", sum("count")::BIGINT AS "sum_G_count" FROM GCReferenceStatistics GROUP BY gcId""")
_SPREAD = f"{_span_avg()} AS avg_duration, {_quantile(0.95)} AS p95_duration, max(duration) AS max_duration, count(*) AS count_all, sum(duration)::BIGINT AS S"
_add("gc-concurrent-phases", "GCPhaseConcurrent GCPhaseConcurrentLevel1", f"SELECT name, {_SPREAD} FROM ({_union('GCPhaseConcurrent GCPhaseConcurrentLevel1', 'name, duration')}) GROUP BY name")
_PAUSES = "GCPhasePause GCPhasePauseLevel1 GCPhasePauseLevel2 GCPhasePauseLevel3 GCPhasePauseLevel4"
_add("gc-pause-phases", _PAUSES, f"SELECT arg_max(label, {O}) AS T, name, {_SPREAD} FROM ({_union(_PAUSES, 'name, duration')}) GROUP BY name")
_add("gc-pauses", "GCPhasePause", f"SELECT sum(duration)::BIGINT AS sum_duration, count(*) AS count_duration, min(duration) AS min_duration, trunc(median(duration))::BIGINT AS median_duration, {_span_avg()} AS avg_duration, {_quantile(0.9)} AS p90_duration, {_quantile(0.95)} AS p95_duration, {_quantile(0.99)} AS p99_duration, {_quantile(0.9999)} AS p999_duration, max(duration) AS max_duration FROM GCPhasePause")
_add("gc-cpu-time", "GCCPUTime", 'SELECT sum(userTime)::BIGINT AS "sum_userTime", sum(systemTime)::BIGINT AS "sum_systemTime", sum(realTime)::BIGINT AS "sum_realTime", (epoch_us(max(startTime)) - epoch_us(min(startTime))) * 1000 AS "diff_startTime", count(*) AS count_all FROM GCCPUTime')
_add("compiler-phases", "CompilerPhase", f'SELECT arg_max(phaseLevel, {O}) AS L, phase AS P, {_SPREAD} FROM CompilerPhase GROUP BY phase')
_add("cpu-load", "CPULoad", "SELECT " + ", ".join(f'{f}({x}) AS "{f}_{x}"' for x in ("jvmUser", "jvmSystem", "machineTotal") for f in ("min", "avg", "max")) + " FROM CPULoad")
_add("cpu-load-samples", "CPULoad", 'SELECT startTime AS "startTime", jvmUser AS "jvmUser", jvmSystem AS "jvmSystem", machineTotal AS "machineTotal" FROM CPULoad')
_add("network-utilization", "NetworkUtilization", 'SELECT networkInterface AS "networkInterface", avg(readRate) AS "avg_readRate", max(readRate) AS "max_readRate", avg(writeRate) AS "avg_writeRate", max(writeRate) AS "max_writeRate" FROM NetworkUtilization GROUP BY 1')
for _x in ("committed", "reserved"):
    _add(f"native-memory-{_x}", "NativeMemoryUsage", f'SELECT "type", arg_min_null({_x}, {O}) AS first_{_x}, avg({_x}) AS avg_{_x}, {_last(_x)} AS last_{_x}, max({_x}) AS M FROM NativeMemoryUsage GROUP BY 1')
_add("vm-operations", "ExecuteVMOperation", f"SELECT operation, {_span_avg()} AS avg_duration, max(duration) AS max_duration, count(*) AS count_all, sum(duration)::BIGINT AS sum_duration FROM ExecuteVMOperation GROUP BY 1")
_BOTH = "SELECT tlabSize AS i, NULL AS o FROM ObjectAllocationInNewTLAB UNION ALL SELECT NULL, allocationSize FROM ObjectAllocationOutsideTLAB"
_add("tlabs", "ObjectAllocationInNewTLAB ObjectAllocationOutsideTLAB", "SELECT " + ", ".join(f'{f}({x}){"::BIGINT" if f == "sum" else ""} AS "{f}_{n}"' for x, n in (("i", "I_tlabSize"), ("o", "O_allocationSize")) for f in ("count", "min", "avg", "max", "sum")) + f" FROM ({_BOTH})")
_add("longest-compilations", "Compilation", 'SELECT startTime AS "startTime", duration AS D, method, compileLevel AS "compileLevel", succeded FROM Compilation ORDER BY duration DESC, startTime, seq LIMIT 25')
_add("longest-class-loading", "ClassLoad", 'SELECT startTime AS "startTime", loadedClass AS "loadedClass", duration AS D FROM ClassLoad ORDER BY duration DESC, startTime, seq LIMIT 25')
_add("system-processes", "SystemProcess", f'SELECT min(startTime) AS "first_startTime", max(startTime) AS "last_startTime", arg_min_null(pid, {O}) AS first_pid, arg_min_null(commandLine, {O}) AS "first_commandLine" FROM SystemProcess GROUP BY pid')
_add("exception-count", "ExceptionStatistics", f"SELECT arg_max(throwables, {O}) - arg_min(throwables, {O}) AS diff_throwables FROM ExceptionStatistics")
_add("finalizers", "FinalizerStatistics", f'SELECT arg_max(finalizableClass, {O}) AS "finalizableClass", {_last("objects")} AS O, {_last("totalFinalizersRun")} AS "last_batch_totalFinalizersRun" FROM FinalizerStatistics GROUP BY finalizableClass HAVING max(startTime) = (SELECT max(startTime) FROM FinalizerStatistics)')
_COUNTS = "ObjectCountAfterGC ObjectCount"
_add("object-statistics", _COUNTS, f"""SELECT {_last('objectClass')} AS "last_batch_objectClass", {_last('"count"')} AS last_batch_count, {_last('totalSize')} AS Z, arg_max(totalSize, {O}) - arg_min(totalSize, {O}) AS "diff_totalSize" FROM ({_union(_COUNTS, 'objectClass, "count", totalSize')}) u GROUP BY objectClass HAVING max(startTime) = (SELECT max(startTime) FROM ({_union(_COUNTS, 'objectClass')}))""")
_add("thread-allocation", "ThreadAllocationStatistics", f'SELECT thread, {_last("allocated")} AS last_allocated, {_last("allocated")} AS A, {_last("allocated")} / sum({_last("allocated")}) OVER () AS "A_share" FROM ThreadAllocationStatistics GROUP BY thread')
for _name, _key, _as in (("allocation-by-class", "objectClass", "O"), ("allocation-by-thread", "eventThread", "T")):
    _add(_name, "ObjectAllocationSample", f'SELECT {_key} AS {_as}, sum(weight)::BIGINT AS W, sum(weight) / sum(sum(weight)) OVER () AS "W_share" FROM ObjectAllocationSample GROUP BY 1 ORDER BY W DESC LIMIT 25')
_add("thread-cpu-load", "ThreadCPULoad", f'SELECT eventThread AS E, {_last(chr(34) + "system" + chr(34))} AS last_system, {_last(chr(34) + "user" + chr(34))} AS U FROM ThreadCPULoad GROUP BY 1')
_add("environment-variables", "InitialEnvironmentVariable", f'SELECT {_last("key")} AS K, {_last("value")} AS last_value FROM InitialEnvironmentVariable GROUP BY "key"')
_add("system-properties", "InitialSystemProperty", f'SELECT "key" AS K, arg_max("value", {O}) AS "value" FROM InitialSystemProperty GROUP BY 1')
_add("class-loaders", "ClassLoaderStatistics", f'SELECT classLoader AS "classLoader", {_last("hiddenClassCount")} AS "last_hiddenClassCount", {_last("classCount")} AS C FROM ClassLoaderStatistics GROUP BY 1')
_STOPS = """SELECT safepointId AS k, startTime, seq, 'B' AS a, jniCriticalThreadCount AS j, totalThreadCount AS t, NULL AS d FROM SafepointBegin UNION ALL SELECT safepointId, startTime, seq, 'E', NULL, NULL, NULL FROM SafepointEnd
UNION ALL SELECT safepointId, startTime, seq, 'C', NULL, NULL, duration FROM SafepointCleanup UNION ALL SELECT safepointId, startTime, seq, 'S', NULL, NULL, duration FROM SafepointStateSynchronization"""
_ENDS = "FILTER (a IN ('B', 'E'))"
_add("safepoints", "SafepointBegin SafepointEnd SafepointCleanup SafepointStateSynchronization", f"""SELECT arg_max(startTime, {O}) FILTER (a = 'B') AS "B_startTime", CASE WHEN count(*) {_ENDS} = 1 THEN 9223372036854775807 WHEN count(*) {_ENDS} > 1 THEN (epoch_us(max(startTime) {_ENDS}) - epoch_us(min(startTime) {_ENDS})) * 1000 END AS "diff_B_E_startTime",
arg_max(d, {O}) FILTER (a = 'S') AS "S_duration", arg_max(d, {O}) FILTER (a = 'C') AS "C_duration", arg_max(j, {O}) AS "jniCriticalThreadCount", arg_max(t, {O}) AS "totalThreadCount" FROM ({_STOPS}) GROUP BY k""")
_add("native-libraries", "NativeLibrary", f'SELECT name AS N, arg_max(baseAddress, {O}) AS "baseAddress", arg_max(topAddress, {O}) AS "topAddress" FROM NativeLibrary GROUP BY 1')
_add("thread-count", "JavaThreadStatistics", 'SELECT seq, startTime AS "startTime", "activeCount", "peakCount" FROM JavaThreadStatistics')
_add("recording", "FileRead Shutdown", f"""SELECT count(*) AS "count_startTime", min(startTime) AS "first_startTime", max(startTime) AS "last_startTime", (epoch_us(max(startTime)) - epoch_us(min(startTime))) * 1000 AS "diff_startTime", (SELECT {_last('reason')} FROM Shutdown) AS "last_jdk_Shutdown_reason" FROM ({_union('FileRead Shutdown', '1 AS one')})""")
for _name in ("events-by-count", "events-by-name"):
    _add(_name, "FileRead SocketWrite ThreadPark", f"SELECT label AS E, count(*) AS C FROM ({_union('FileRead SocketWrite ThreadPark', '1 AS one')}) GROUP BY 1")
for _name, _type in (("compiler-configuration", "CompilerConfiguration"), ("container-cpu-usage", "ContainerCPUUsage"), ("container-memory-usage", "ContainerMemoryUsage"), ("container-io-usage", "ContainerIOUsage"), ("container-cpu-throttling", "ContainerCPUThrottling"), ("cpu-tsc", "CPUTimeStampCounter"), ("heap-configuration", "GCHeapConfiguration"), ("jvm-information", "JVMInformation")):
    _add(_name, _type, "SELECT " + ", ".join(f'{_last(f)} AS "last_{f}"' for f in TYPES[_type][1]) + f" FROM {_type}")
_add("cpu-information", "CPUInformation", 'SELECT cpu, sockets, cores, hwThreads AS "hwThreads", description FROM CPUInformation ORDER BY startTime, seq LIMIT 1')
_of = lambda t, *names: [f'(SELECT {_last(n)} FROM {t}) AS "last_{n}"' for n in names]
_add("system-information", "CPUInformation PhysicalMemory OSInformation", "SELECT " + ", ".join(_of("PhysicalMemory", "totalSize") + _of("OSInformation", "osVersion") + _of("CPUInformation", "cpu", "cores", "hwThreads", "sockets", "description")))
