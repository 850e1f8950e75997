"""Names of the monitored system: nodes, services, pods and metrics.

All of them are defaults; every operator that uses one takes it as a parameter.
"""

from __future__ import annotations

# Local zone of the file names, margins and widths.
LOCAL_ZONE = "Asia/Shanghai"
SECOND_NS = 1_000_000_000
MINUTE_NS = 60 * SECOND_NS
HOUR_NS = 60 * MINUTE_NS
NORMAL_MARGIN_NS = 10 * MINUTE_NS
RECOVERY_NS = 40 * MINUTE_NS
BIN_NS = 30 * SECOND_NS
SAMPLE_INCIDENTS = 50
SAMPLE_SEED = 42
FOREST_TREES = 100
FOREST_CONTAMINATION = 0.01
TOP_K = 20
STABLE_RATIO = 0.05
TRIM_EACH_SIDE = 2
SKIPPED_DEVICE = "/dev/dmb"

# The closed list of components.
NODES = [f"aiops-k8s-{i:02d}" for i in range(1, 9)]
REPLICATED_SERVICES = [
    "cartservice", "currencyservice", "frontend", "adservice",
    "recommendationservice", "shippingservice", "checkoutservice",
    "paymentservice", "emailservice", "productcatalogservice",
]
SINGLE_SERVICES = ["redis-cart"]
DB_COMPONENTS = ["tidb-tidb", "tidb-pd", "tidb-tikv"]
SERVICES = REPLICATED_SERVICES + SINGLE_SERVICES + DB_COMPONENTS
PODS = [f"{s}-{i}" for s in REPLICATED_SERVICES for i in range(3)] + ["redis-cart-0"]
SERVICE_ALIASES = {"redis": "redis-cart"}

# Metric names per entity kind.
APM_METRICS = [
    "client_error_ratio", "error_ratio", "request", "response", "rrt",
    "server_error_ratio", "timeout",
]
NODE_METRICS = [
    "node_cpu_usage_rate",
    "node_disk_read_bytes_total",
    "node_disk_read_time_seconds_total",
    "node_disk_write_time_seconds_total",
    "node_disk_written_bytes_total",
    "node_filesystem_free_bytes",
    "node_filesystem_usage_rate",
    "node_memory_MemAvailable_bytes",
    "node_memory_MemTotal_bytes",
    "node_memory_usage_rate",
    "node_network_receive_bytes_total",
    "node_network_receive_packets_total",
    "node_network_transmit_bytes_total",
    "node_network_transmit_packets_total",
    "node_sockstat_TCP_inuse",
]
EXTRA_NODE_METRICS = ["node_filesystem_size_bytes"]
POD_METRICS = [
    "pod_cpu_usage", "pod_fs_reads_bytes", "pod_fs_writes_bytes",
    "pod_memory_working_set_bytes", "pod_network_receive_bytes",
    "pod_network_receive_packets", "pod_network_transmit_bytes",
    "pod_network_transmit_packets", "pod_processes",
]
DB_METRICS = {
    "tidb-tidb": [
        "failed_query_ops", "duration_99th", "connection_count",
        "server_is_up", "cpu_usage", "memory_usage",
    ],
    "tidb-pd": [
        "store_up_count", "store_down_count", "store_unhealth_count",
        "storage_used_ratio", "cpu_usage", "memory_usage",
    ],
    "tidb-tikv": [
        "cpu_usage", "memory_usage", "server_is_up", "available_size",
        "raft_propose_wait", "raft_apply_wait", "rocksdb_write_stall",
    ],
}

# Labels shown for node metrics.
METRIC_LABELS = {
    "node_cpu_usage_rate": "CPU使用率",
    "node_disk_read_bytes_total": "磁盘读取字节数",
    "node_disk_read_time_seconds_total": "磁盘读取时间",
    "node_disk_write_time_seconds_total": "磁盘写入时间",
    "node_disk_written_bytes_total": "磁盘写入字节数",
    "node_filesystem_free_bytes": "空闲磁盘大小",
    "node_filesystem_size_bytes": "磁盘总大小",
    "node_filesystem_usage_rate": "文件系统使用率",
    "node_memory_MemAvailable_bytes": "空闲内存大小",
    "node_memory_MemTotal_bytes": "内存总大小",
    "node_memory_usage_rate": "内存使用率",
    "node_network_receive_bytes_total": "网络接收字节数",
    "node_network_receive_packets_total": "Receive 各个接口每秒接收的数据包总数",
    "node_network_transmit_bytes_total": "Transmit 各个网络接口发送速率",
    "node_network_transmit_packets_total": "Transmit 各个接口每秒发送的数据包总数",
    "node_sockstat_TCP_inuse": "TCP连接数",
}

# Texts of rendered evidence.
COUNT_LABEL = "出现次数:"
MISSING_LABEL = "缺失数据"
REPORT_LABELS = {
    "normal_p50": "正常期间中位数",
    "normal_iqr": "正常期间四分位距",
    "normal_p99": "正常期间99分位数",
    "fault_p50": "故障期间中位数",
    "fault_iqr": "故障期间四分位距",
    "fault_p99": "故障期间99分位数",
}

# Log template mining.
TOKEN_DELIMITERS = "_|:=,"
PREFIX_TOKENS = 7
WILDCARD = "<*>"
MAX_EXAMPLES = 1000
TOP_TEMPLATES = 1000
