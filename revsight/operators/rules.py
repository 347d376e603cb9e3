"""The regular-expression rules of source scans.

They are data that results must agree with, kept in the order in which they are tried.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    rule_id: str
    pattern: str
    severity: str
    title: str
    description: str


# Patterns by language, tried without case and with ^ and $ at line ends.
SECURITY: dict[str, tuple[Pattern, ...]] = {
    "python": (
        Pattern("hardcoded_password", r"""password\s*=\s*["'][^"']{8,}["']""", "critical", "Hardcoded Password", "Hardcoded password found in source code"),
        Pattern("sql_injection", r"""\.execute\s*\(\s*["'].*%.*["'].*%""", "high", "Potential SQL Injection", "String formatting in SQL query may lead to injection"),
        Pattern("command_injection", r"""(subprocess|os\.system|os\.popen)\s*\([^)]*\+|%""", "high", "Command Injection Risk", "Dynamic command construction may allow injection"),
        Pattern("weak_crypto", r"""hashlib\.(md5|sha1)\(""", "medium", "Weak Cryptographic Hash", "MD5/SHA1 are cryptographically weak"),
        Pattern("insecure_random", r"""random\.(random|randint|choice)""", "medium", "Insecure Random Generator", "Use secrets module for security-sensitive random values"),
        Pattern("eval_usage", r"""\beval\s*\(""", "high", "Dangerous eval() Usage", "eval() can execute arbitrary code"),
        Pattern("pickle_usage", r"""pickle\.loads?\s*\(""", "high", "Unsafe Deserialization", "pickle.load can execute arbitrary code"),
        Pattern("debug_mode", r"""debug\s*=\s*True""", "medium", "Debug Mode Enabled", "Debug mode should not be enabled in production"),
    ),
    "javascript": (
        Pattern("eval_usage", r"""\beval\s*\(""", "high", "Dangerous eval() Usage", "eval() can execute arbitrary code"),
        Pattern("innerHTML_xss", r"""\.innerHTML\s*=.*\+""", "high", "Potential XSS via innerHTML", "Dynamic content in innerHTML may allow XSS"),
        Pattern("document_write", r"""document\.write\s*\(""", "medium", "document.write Usage", "document.write can be exploited for XSS"),
        Pattern("insecure_random", r"""Math\.random\s*\(""", "medium", "Insecure Random Generator", "Math.random is not cryptographically secure"),
    ),
    "java": (
        Pattern("sql_injection", r"""Statement.*executeQuery\s*\([^?]*\+""", "high", "SQL Injection Vulnerability", "String concatenation in SQL query"),
        Pattern("path_traversal", r"""new\s+File\s*\([^)]*\+""", "high", "Path Traversal Risk", "Dynamic file path construction"),
        Pattern("weak_crypto", r"""MessageDigest\.getInstance\s*\(\s*["']MD5|SHA1["']""", "medium", "Weak Cryptographic Hash", "MD5/SHA1 are cryptographically weak"),
    ),
}

# What is suggested for a rule.
FIXES = {
    "hardcoded_password": "Use environment variables or secure configuration management",
    "sql_injection": "Use parameterized queries or prepared statements",
    "command_injection": "Validate and sanitize all inputs, avoid shell=True",
    "weak_crypto": "Use SHA-256 or stronger cryptographic hash functions",
    "insecure_random": "Use secrets module for cryptographically secure random values",
    "eval_usage": "Avoid eval(), use safer alternatives like ast.literal_eval",
    "pickle_usage": "Use JSON or other safe serialization formats",
    "debug_mode": "Disable debug mode in production environments",
    "innerHTML_xss": "Sanitize user input or use textContent instead of innerHTML",
    "document_write": "Use DOM manipulation methods instead of document.write",
    "assert_in_production": "Use proper error handling instead of assert statements",
    "except_pass": "Log errors or handle them appropriately, avoid silent failures",
    "shell_true": "Use shell=False and validate inputs, or use safer alternatives",
}

# Secrets in configuration files, credentials in tests, packages with known faults.
CONFIG_SECRETS = (
    (r"""password\s*[=:]\s*["'][^"']{4,}["']""", "Password in config file"),
    (r"""api[_-]?key\s*[=:]\s*["'][^"']{10,}["']""", "API key in config file"),
    (r"""secret[_-]?key\s*[=:]\s*["'][^"']{10,}["']""", "Secret key in config file"),
    (r"""token\s*[=:]\s*["'][^"']{10,}["']""", "Token in config file"),
)
# What findings by the kind of file say.
CONFIG_TEXT, CONFIG_FIX = "Sensitive information should not be stored in config files", "Use environment variables or secure configuration management"
TEST_TITLE, TEST_TEXT = "Hardcoded Credentials in Tests", "Test files should not contain real credentials"
TEST_FIX = "Use mock credentials or environment variables for testing"
PACKAGE_TITLE, PACKAGE_TEXT, PACKAGE_FIX = "Vulnerable Dependency: {}", "Package {} has known security vulnerabilities", "Update {} to a secure version"
TEST_CREDENTIALS = r"""password.*=.*["'][^"']{8,}["']"""
VULNERABLE = {"requests": ("2.25.0", "2.25.1"), "flask": ("1.0.0", "1.0.1"), "django": ("2.2.0", "2.2.1")}

# Custom rules by name.
CUSTOM = {
    "no_hardcoded_secrets": (r"""password\s*=\s*["'][^"']+["']""", r"""api_key\s*=\s*["'][^"']+["']""", r"""secret\s*=\s*["'][^"']+["']"""),
    "no_debug_prints": (r"""print\s*\(""", r"""console\.log\s*\("""),
    "no_todo_comments": (r"""#\s*TODO""", r"""//\s*TODO""", r"""/\*\s*TODO"""),
}

# Definitions in source text, by language; the kind, the pattern, and which group is the name.
STRUCTURE: dict[str, tuple[tuple[str, str, int], ...]] = {
    "javascript": (
        ("function", r"function\s+(\w+)\s*\([^)]*\)\s*\{", 1),
        ("function", r"(\w+)\s*:\s*function\s*\([^)]*\)\s*\{", 1),
        ("function", r"(\w+)\s*=\s*function\s*\([^)]*\)\s*\{", 1),
        ("function", r"(\w+)\s*=\s*\([^)]*\)\s*=>\s*\{", 1),
        ("class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?\s*\{", 1),
        ("import", r"""import\s+(\w+)\s+from\s+['"]([^'"]+)['"]""", 2),
        ("import", r"""import\s+\{([^}]+)\}\s+from\s+['"]([^'"]+)['"]""", 2),
        ("import", r"""import\s+['"]([^'"]+)['"]""", 1),
    ),
    "java": (
        ("class", r"(?:public|private|protected)?\s*class\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?\s*\{", 1),
        ("method", r"(?:public|private|protected|static).*?\s+(\w+)\s*\([^)]*\)\s*\{", 1),
        ("import", r"import\s+(?:static\s+)?([^;]+);", 1),
    ),
    "cpp": (
        ("function", r"(?:inline\s+)?(?:static\s+)?(?:virtual\s+)?(?:\w+(?:\s*\*|\s*&)?)\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?(?:final\s*)?\{", 1),
        ("class", r"class\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+(\w+))?\s*\{", 1),
        ("include", r'#include\s*[<"]([^>"]+)[>"]', 1),
    ),
    "c": (
        ("function", r"(?:static\s+)?(?:inline\s+)?(?:\w+(?:\s*\*)?)\s+(\w+)\s*\([^)]*\)\s*\{", 1),
        ("struct", r"(?:typedef\s+)?struct\s+(\w+)?\s*\{", 1),
        ("include", r'#include\s*[<"]([^>"]+)[>"]', 1),
    ),
}
STRUCTURE["typescript"] = (*STRUCTURE["javascript"], ("interface", r"interface\s+(\w+)\s*\{", 1))

# Paths whose change is critical, tried in order from the start of the path without case.
CRITICAL_PATHS = (r".*config.*", r".*\.env.*", r".*security.*", r".*auth.*", r".*password.*", r".*secret.*", r".*key.*", r"requirements\.txt", r"package\.json", r"Dockerfile", r".*\.sql")
#: What every such path holds in lower case, one of these at least.
CRITICAL_HOLD = ("config", ".env", "security", "auth", "password", "secret", "key", "requirements.txt", "package.json", "dockerfile", ".sql")

# Definitions on changed lines, by language; the first group of each, if it has one, is the name.
CHANGED_DEFINITIONS = {
    "python": (r"^def\s+(\w+)\s*\(",),
    "javascript": (r"function\s+(\w+)\s*\(", r"(\w+)\s*:\s*function\s*\(", r"(\w+)\s*=\s*function\s*\(", r"(\w+)\s*=\s*\([^)]*\)\s*=>\s*\{"),
    "java": (r"(?:public|private|protected).*?\s+\w+\s*\(",),
}
#: What every such line holds, one of these at least.
DEFINITIONS_HOLD = {"python": ("def",), "javascript": ("function", "=>"), "java": ("public", "private", "protected")}
