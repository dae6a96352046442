"""Classification rules, cleaning patterns, word lists and labels."""

from __future__ import annotations

# Classification rules: the first category, then the first pattern, that hits decides.
RULES: dict[str, tuple[str, ...]] = {
    "memory_error": (
        r"\b(out of memory|oom|page allocation failure|dma timeout)\b",
        r"\b(malloc failed|memory leak|segfault|kernel panic)\b",
        r"\b(swap.*full|virtual memory|memory pressure)\b"),
    "authentication_error": (
        r"\b(authentication failure|invalid username|login failed)\b",
        r"\b(kerberos.*failed|pam_unix.*failed|ssh.*failed)\b",
        r"\b(password.*incorrect|access denied|unauthorized)\b"),
    "filesystem_error": (
        r"\b(no such file|permission denied|disk full|quota exceeded)\b",
        r"\b(failed command|status timeout|drive not ready|io error)\b",
        r"\b(filesystem.*corrupt|bad sector|read.*error)\b"),
    "network_error": (
        r"\b(connection timed out|connection refused|peer died)\b",
        r"\b(network unreachable|socket error|host.*down)\b",
        r"\b(dns.*failed|routing.*error|packet.*lost)\b"),
    "permission_error": (
        r"\b(permission denied|operation not supported|access forbidden)\b",
        r"\b(selinux.*denied|capability.*denied|privilege.*error)\b",
        r"\b(sudo.*failed|su.*failed|root.*access)\b"),
    "system_critical": (
        r"\b(critical|fatal|panic|emergency|alert)\b",
        r"\b(system.*halt|kernel.*oops|hardware.*error)\b",
        r"\b(temperature.*critical|power.*failure)\b"),
}

WEIGHTS: dict[str, float] = {
    "memory_error": 0.9,
    "authentication_error": 0.95,
    "filesystem_error": 0.85,
    "network_error": 0.8,
    "permission_error": 0.9,
    "system_critical": 0.95,
}

CRITICAL_TYPES = ("system_critical", "authentication_error")
NORMAL_TYPE, NORMAL_CONFIDENCE = "normal", 0.7

# Types that the dashboard counts as threats.
THREAT_TYPES = ("system_critical", "memory_error", "authentication_error",
                "filesystem_error", "network_error", "permission_error")

# Flags of a log's content: one whole-word pattern each.
CONTENT_FLAGS: dict[str, str] = {
    "content_has_error": r"\b(error|fail|exception|crash|abort|fault)\b",
    "content_has_warning": r"\b(warn|alert|caution)\b",
    "content_has_large_numbers": r"\b\d{4,}\b",
    "content_has_critical": r"\b(critical|fatal|panic|segfault|timeout|killed)\b",
    "content_has_network": r"\b(connection|socket|port|network|tcp|udp)\b",
    "content_has_memory": r"\b(memory|malloc|free|leak|oom|out of memory)\b",
}

# Patterns whose hits are removed from training data.
CLEANING_PATTERNS: dict[str, tuple[str, ...]] = {
    "authentication_errors": (
        r"\b(authentication failure|invalid username|login failed)\b",
        r"\b(password.*incorrect|access denied|unauthorized)\b",
        r"\b(kerberos.*failed|pam_unix.*failed|ssh.*failed)\b",
        r"\b(failed.*login|login.*denied|bad.*password)\b",
        r"\b(authentication.*error|auth.*fail|credential.*invalid)\b"),
    "memory_errors": (
        r"\b(out of memory|oom|page allocation failure|dma timeout)\b",
        r"\b(malloc failed|memory leak|segfault|kernel panic)\b",
        r"\b(swap.*full|virtual memory|memory pressure)\b",
        r"\b(memory.*error|memory.*fault|allocation.*failed)\b",
        r"\b(stack overflow|buffer overflow|heap.*corruption)\b"),
    "filesystem_errors": (
        r"\b(no such file|permission denied|disk full|quota exceeded)\b",
        r"\b(failed command|status timeout|drive not ready|io error)\b",
        r"\b(filesystem.*corrupt|bad sector|read.*error)\b",
        r"\b(file.*not.*found|directory.*not.*found|path.*invalid)\b",
        r"\b(disk.*error|mount.*failed|unmount.*error)\b"),
    "network_errors": (
        r"\b(connection timed out|connection refused|peer died)\b",
        r"\b(network unreachable|socket error|host.*down)\b",
        r"\b(dns.*failed|routing.*error|packet.*lost)\b",
        r"\b(connection.*reset|connection.*aborted|network.*error)\b",
        r"\b(timeout.*occurred|unreachable.*host|broken.*pipe)\b"),
    "permission_errors": (
        r"\b(permission denied|operation not supported|access forbidden)\b",
        r"\b(selinux.*denied|capability.*denied|privilege.*error)\b",
        r"\b(sudo.*failed|su.*failed|root.*access.*denied)\b",
        r"\b(insufficient.*privileges|unauthorized.*access)\b"),
    "system_critical": (
        r"\b(critical|fatal|panic|emergency|alert)\b",
        r"\b(system.*halt|kernel.*oops|hardware.*error)\b",
        r"\b(temperature.*critical|power.*failure)\b",
        r"\b(service.*failed|daemon.*crashed|process.*killed)\b",
        r"\b(system.*crash|kernel.*crash|fatal.*error)\b"),
    "security_events": (
        r"\b(intrusion|attack|malware|virus|trojan)\b",
        r"\b(suspicious.*activity|security.*violation|breach)\b",
        r"\b(unauthorized.*attempt|illegal.*access)\b",
        r"\b(firewall.*blocked|ips.*alert|ids.*detection)\b"),
    "application_errors": (
        r"\b(exception|error|fail|crash|abort|fault)\b",
        r"\b(stack.*trace|null.*pointer|index.*out.*of.*bounds)\b",
        r"\b(connection.*lost|timeout.*expired|operation.*failed)\b",
        r"\b(service.*unavailable|internal.*error|bad.*request)\b"),
}
ERROR_LEVELS = ("ERROR", "CRITICAL", "FATAL", "ALERT", "EMERGENCY")
PROBLEM_COMPONENTS = ("kernel", "oom-killer", "segfault", "audit", "firewall",
                      "fail2ban", "sshguard", "intrusion", "security")

# Words left out of template features.
STOP_WORDS = (
    "at", "by", "for", "from", "to", "in", "on", "with", "of", "the", "a", "an",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "and", "or", "but", "if", "then", "else", "when", "where", "why", "how",
    "this", "that", "these", "those", "it", "its", "they", "them", "their")

# Severity percentiles and labels; the flag percentile; window length and stride.
SEVERITY_PERCENTILES = (85, 95, 99)
SEVERITY_LABELS = ("Low", "Medium", "High", "Critical")
FLAG_PERCENTILE = 95
WINDOW_LENGTH = 8
WINDOW_STRIDE = 8

# Columns a parsed table must, should and may have.
REQUIRED_COLUMNS = ("event_template", "event_id")
RECOMMENDED_COLUMNS = ("content", "level", "component", "date", "time")
BENEFICIAL_COLUMNS = ("line_id", "month")

# Alert limits.
ALERT_LIMITS = {"critical": 1, "high": 5, "rate": 10.0, "sequential": 3, "single_log": 10, "hybrid": 5}

# Layouts of collected syslog lines, tried in order.
AUTH_LINE = r"(\w+ \d+ \d+:\d+:\d+) ([\w\-.]+) ([\w\-]+)(\[(\d+)\])?: (.*)"
SYSLOG_LINE = r"(\w{3} \d{1,2} \d{2}:\d{2}:\d{2}) ([\w\-.]+) ([\w\-.]+)(?:\[(\d+)\])?: (.+)"
KERNEL_LINE = r"(\w{3} \d{1,2} \d{2}:\d{2}:\d{2}) ([\w\-.]+) kernel: \[([\d\.]+)\] (.+)"
NOISE_WORDS = ("filebeat", "monitoring")
NOISE_PROGRAM = "filebeat"
