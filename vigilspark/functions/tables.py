"""Lookup tables that results depend on.

Fixed values: extensions, enum names, ranks, list members and constants below are part of the data contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions of each language.
EXTENSIONS: dict[str, tuple[str, ...]] = {
    "php": ("php", "php3", "php4", "php5", "php7", "phtml", "pht", "inc", "phar"),
    "jsp": ("jsp", "jspx", "jspf", "jsw", "jsv", "jhtml"),
    "asp": ("asp", "asa", "cer", "cdx"),
    "aspx": ("aspx", "ascx", "ashx", "asmx", "asax", "cshtml", "vbhtml", "master", "svc"),
    "perl": ("pl", "pm", "plx", "pl6"),
    "python": ("py", "pyw", "py3", "pyi", "pyp", "pyx"),
    "cgi": ("cgi", "fcgi"),
    "shtml": ("shtml", "shtm", "stm"),
    "config": ("config",),
    "static": ("html", "htm", "js", "css"),
    "jvm-artifact": ("java", "class", "jar", "war"),
}
WEB_SOURCE = ("php", "jsp", "asp", "aspx", "perl", "python", "cgi", "shtml")
LANGUAGE_OF = {e: lang for lang, exts in EXTENSIONS.items() for e in exts}

# Languages that a rule's declared scope covers, by file context, and by content where the name says nothing.
SCOPE_CONTEXTS: dict[str, tuple[str, ...]] = {
    "web-generic": ("php", "jsp", "asp", "aspx", "config"),
    "php": ("php",),
    "jsp": ("jsp",),
    "java": ("jsp",),
    "asp": ("asp",),
    "aspx": ("aspx",),
    "dotnet": ("aspx",),
    "asp-family": ("asp", "aspx", "config"),
    "perl": ("perl", "cgi"),
    "python": ("python", "cgi"),
    "shtml": ("shtml",),
}
SCOPE_SIGNS: dict[str, tuple[str, ...]] = {
    "web-generic": ("php", "jsp", "asp", "aspx"),
    "php": ("php",),
    "jsp": ("jsp",),
    "java": ("jsp",),
    "asp": ("asp",),
    "aspx": ("aspx",),
    "dotnet": ("aspx",),
    "asp-family": ("asp", "aspx"),
    "perl": ("perl", "cgi"),
    "python": ("python", "cgi"),
    "shtml": ("shtml",),
}

# Tiers, and their three different orders.
VERDICT_RANK = {"confirmed": 3, "likely-malicious": 2, "suspicious": 1}
TRIAGE_RANK = {"clean": 0, "unknown": 1, "suspicious": 2, "likely-malicious": 3, "confirmed": 4}
DISPLAY_RANK = {"clean": 0, "unknown": 1, "suspicious": 2, "likely-malicious": 3, "confirmed": 4}  # anything else: -1
STATUS_RANK = {"complete": 0, "degraded": 1, "failed": 2}
PROVENANCE_RANK = {"explicit": 3, "config": 2, "convention": 1}

# Families with an attributed tool, and the constants that give a family away.
ATTRIBUTED_FAMILIES = ("Behinder", "Godzilla", "AntSword", "ChinaChopper", "IceScorpion")
FAMILY_CONSTANTS = (("e45e329feb5d925b", "Behinder"), ("3c6e0b8a9c15224a", "Godzilla"))

# Detection bases by how fusion treats them.
CONTENT_BASES = ("signature", "heuristic", "taint")
MEMORY_BASES = ("structural-heuristic", "provenance-anomaly", "memory-region-anomaly", "etw-dynamic-load", "reachability-dispatch", "stomp-diff")
CREDIBLE_BASES = ("signature", "structural-heuristic", "behavioral", "provenance-anomaly", "memory-region-anomaly", "etw-dynamic-load", "reachability-dispatch")

# Evidence words of components wired into the web server.
IIS_CONTRACTS = ("pipeline", "IHttpModule", "IHttpHandler", "HttpApplication", "VirtualPathProvider", "IRouter", "IEndpointRouteBuilder", "IStartupFilter", "IMiddleware", "IOwinMiddleware", "convention-middleware")

# Children of the IIS worker process that mean a shell, and those that are expected.
SHELL_CHILDREN = (
    "cmd.exe", "powershell.exe", "pwsh.exe", "cscript.exe", "wscript.exe", "mshta.exe", "wsl.exe", "bash.exe", "rundll32.exe",
    "regsvr32.exe", "installutil.exe", "msbuild.exe", "bitsadmin.exe", "certutil.exe", "curl.exe", "ftp.exe", "net.exe", "net1.exe",
    "whoami.exe", "wmic.exe", "reg.exe", "sc.exe", "tasklist.exe", "systeminfo.exe", "ipconfig.exe", "nltest.exe", "arp.exe",
    "dsquery.exe", "netstat.exe", "route.exe", "hostname.exe", "quser.exe", "schtasks.exe", "at.exe", "psexec.exe", "psexec64.exe",
)
EXPECTED_CHILDREN = ("csc.exe", "vbc.exe", "cvtres.exe", "conhost.exe", "w3wp.exe", "werfault.exe", "wermgr.exe")

# Contracts whose implementers sit on a Java server's request path.
PIPELINE_CONTRACTS = (
    "javax.servlet.Filter", "javax.servlet.Servlet", "javax.servlet.http.HttpServlet", "javax.servlet.ServletRequestListener",
    "javax.servlet.http.HttpSessionListener", "javax.servlet.ServletContextListener", "jakarta.servlet.Filter", "jakarta.servlet.Servlet",
    "jakarta.servlet.http.HttpServlet", "jakarta.servlet.ServletRequestListener", "jakarta.servlet.http.HttpSessionListener",
    "jakarta.servlet.ServletContextListener", "org.apache.catalina.Valve", "org.apache.catalina.valves.ValveBase", "org.apache.catalina.Container",
    "org.apache.catalina.LifecycleListener", "org.apache.coyote.Adapter", "org.springframework.web.servlet.HandlerInterceptor",
    "org.springframework.web.servlet.handler.HandlerInterceptorAdapter", "org.springframework.web.servlet.mvc.Controller",
    "org.springframework.web.filter.OncePerRequestFilter", "com.opensymphony.xwork2.interceptor.Interceptor",
    "org.apache.struts2.interceptor.AbstractInterceptor", "org.eclipse.jetty.server.Handler", "org.eclipse.jetty.server.handler.AbstractHandler",
    "io.undertow.server.HttpHandler", "javax.websocket.Endpoint", "jakarta.websocket.Endpoint", "javax.websocket.server.ServerEndpointConfig",
    "java.lang.instrument.ClassFileTransformer",
)


def literal_map(entries: dict) -> Column:
    return F.create_map(*(F.lit(v) for pair in entries.items() for v in pair))


def rank(column: Column | str, ranks: dict[str, int], other: int = 0) -> Column:
    """A tier's or status's place in one of the orders."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.element_at(literal_map(ranks), c), F.lit(other))
