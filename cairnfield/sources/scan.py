"""Source trees as tables: glob scan, metadata, exclusion, size guard, configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

#: Extension to language, markers of a language's workspaces, directories never scanned, size guard.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "vue": "vue", "svelte": "svelte",
    "py": "python", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp",
}
MARKERS = {"javascript": "package.json", "typescript": "tsconfig.json", "python": "pyproject.toml", "java": "pom.xml", "kotlin": "build.gradle.kts", "go": "go.mod", "rust": "Cargo.toml"}
EXCLUDED = ("node_modules", ".git", "dist", "build", "target", "__pycache__", ".venv", "venv", "coverage", "vendor")
MOST_BYTES, MOST_DEPTH = 1 << 20, 12


def language(path: Column) -> Column:
    ext, out = paths.extension(path), F
    for e, name in LANGUAGES.items():
        out = out.when(ext == e, name)
    return out.otherwise("unknown")


def patterns(markers: Sequence[str]) -> list[str]:
    """Extensions to scan: of the languages whose marker is among the files, or of all where none is."""
    found = {lang for lang, m in MARKERS.items() if m in markers}
    if "javascript" in found or "typescript" in found:
        found |= {"javascript", "typescript", "vue", "svelte"}
    return [e for e, lang in LANGUAGES.items() if not found or lang in found]


def excluded(path: Column, more: Sequence[str] = ()) -> Column:
    """A directory of the path is on the list."""
    import re

    names = "|".join(re.escape(n) for n in (*EXCLUDED, *more))
    return F.concat(F.lit("/"), path).rlike(f"/({names})/")


def scan(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, exclude: Sequence[str] = (), depth: int = MOST_DEPTH, guard: int = MOST_BYTES) -> DataFrame:
    """Path (below root), mtime, size, hash, line_count, lang, text, parse_mode, parse_mode_reason.

    Files are read by Spark's binary reader, in parallel and from any file system. That reader leaves out empty files;
    below a local root they are added by name, elsewhere they are missing. A file over `guard` bytes keeps its
    metadata but has no text and is not parsed; one that isn't UTF-8 is decoded with replacement marks.
    """
    glob = "*.{" + ",".join(extensions or LANGUAGES) + "}"
    columns = ["path", "modificationTime", "length", "content"]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    if empty := _empty_files(root, extensions or list(LANGUAGES)):
        rows = [(p, datetime.fromtimestamp(t), 0, bytearray()) for p, t in empty]
        raw = raw.select(*columns).union(spark.createDataFrame(rows, raw.select(*columns).schema))
    base = root.split("://", 1)[-1].split(":", 1)[-1] if "://" not in root and root.startswith("file:") else root.split("://", 1)[-1]
    below = F.regexp_replace(F.regexp_extract("path", "^[a-z0-9]+:/*(/.*)$", 1), "^/+", "/")
    rel = F.expr(f"substring(p, {len(base.rstrip('/')) + 2})")
    files = raw.withColumn("p", below).withColumn("path", rel).drop("p")
    files = files.filter(~excluded(F.col("path"), exclude) & (F.size(F.split("path", "/")) <= depth + 1))
    big = F.col("length") > guard
    text = F.when(~big, F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    return files.select(
        "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.when(~big, F.size(F.split(text, "\n", -1))).alias("line_count"),
        language(F.col("path")).alias("lang"), text.alias("text"), F.when(big, "none").otherwise("ast").alias("parse_mode"), F.when(big, "file-too-large").otherwise("ast-success").alias("parse_mode_reason"),
    )


def _empty_files(root: str, extensions: Sequence[str]) -> list[tuple[str, float]]:
    """(URI, time) of empty files below a local root."""
    local = root.removeprefix("file://").removeprefix("file:") if root.startswith("file:") else root
    if "://" in local or not os.path.isdir(local):
        return []
    out = []
    for folder, _, names in os.walk(local):
        for n in names:
            p = os.path.join(folder, n)
            if n.rpartition(".")[2] in extensions and os.path.getsize(p) == 0:
                out.append(("file:" + p, os.path.getmtime(p)))
    return out


def classified(files: DataFrame, directories: Mapping[str, str] | None = None, entries: Sequence[str] = ()) -> DataFrame:
    """file_role, directory_role, is_test, is_mainline and is_entry of files(path, text)."""
    role, where = paths.role(F.col("path")), paths.directory_role(F.col("path"), dict(directories or {}))
    shebang = F.coalesce(F.col("text").startswith("#!"), F.lit(False)) | F.coalesce(F.col("text").rlike(r"if __name__ == ['\"]__main__['\"]"), F.lit(False))
    standalone = F.concat(F.lit("/"), F.col("path")).rlike("/(bin|scripts|benchmark)/")
    listed = F.col("path").isin(*entries) if entries else F.lit(False)
    test = paths.is_test(F.col("path"))
    return files.select("*", role.alias("file_role"), where.alias("directory_role"), test.alias("is_test"), (where == "active").alias("is_mainline"), ((role == "entry") | shebang | standalone | listed | framework_hint(F.col("path"), F.col("text")).isNotNull()).alias("is_entry"), paths.dirname(F.col("path")).alias("package"), paths.extension(F.col("path")).alias("ext"))


#: (framework, path pattern); the first that fits counts.
FRAMEWORK_PATHS: list[tuple[str, str]] = [
    ("next-app", r"(^|/)app/(.*/)?(page|layout|route|loading|error)\.(js|jsx|ts|tsx)$"),
    ("next-pages", r"(^|/)pages/.*\.(jsx?|tsx?)$"),
    ("django", r"(^|/)(urls|wsgi|asgi|manage)\.py$"),
]
#: (family of files, framework, marks), any of which, in any case, tells it; the first that fits counts. Fixed
#: values: frameworks and marks, of which more specific ones come first.
FRAMEWORKS: list[tuple[str, str, tuple[str, ...]]] = [
    ("js", "nestjs", ("@Controller", "@Get(", "@Post(", "@Put(", "@Delete(")),
    ("js", "express", ("app.get(", "app.post(", "router.get(", "router.post(")),
    ("js", "vue", ("from 'vue'", 'from "vue"', "createapp(", "definecomponent(", "vue-router", "pinia")),
    ("js", "vue", ("defineProps(", "defineEmits(", "defineExpose(", "defineOptions(", "defineSlots(", "defineModel(")),
    ("py", "django", ("BaseCommand", "class Command(", "admin.site.register", "MiddlewareMixin", "class Middleware", "def process_request", "def process_response")),
    ("py", "django", ("class DatabaseRouter", "allow_migrate", "db_for_read", "db_for_write", "def context_processors", "def processor(")),
    ("py", "django", ("@register.filter", "@register.simple_tag", "@register.inclusion_tag", "class Form(", "class ModelForm(", "from django import forms", "@receiver", ".connect(")),
    ("py", "django", ("@api_view", "class APIView", "class ModelViewSet", "class ViewSet", "class GenericAPIView", "@action", "@permission_classes", "from rest_framework")),
    ("py", "celery", ("@shared_task", "@app.task")),
    ("py", "fastapi", ("@app.get", "@app.post", "@router.get", "FastAPI(")),
    ("py", "flask", ("@app.route", "@blueprint.route", "Flask(__name__")),
    ("java", "spring-boot", ("@SpringBootApplication", "@Configuration", "@ControllerAdvice", "@Component", "@Service", "@Repository", "@EnableAutoConfiguration", "@Aspect")),
    ("java", "spring", ("@RestController", "@Controller", "@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@FeignClient", "@Scheduled", "@Async", "@EventListener", "@KafkaListener", "@RabbitListener", "@JmsListener", "@Retryable")),
    ("java", "spring", ("@Bean", "FilterRegistrationBean", "implements Filter", "extends HttpServletRequestWrapper", "implements Validator", "implements HandlerInterceptor", "implements ApplicationListener")),
    ("java", "quartz", ("org.quartz.Job", "@DisallowConcurrentExecution", "extends AbstractQuartzJob", "QuartzJobExecution", "JobInvokeUtil")),
    ("java", "mybatis", ("implements TypeHandler", "extends BaseTypeHandler", "TypeHandler<")),
    ("kt", "spring-kotlin", ("@RestController", "@Controller", "@RequestMapping", "@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@PatchMapping", "@FeignClient", "@Scheduled", "@Async", "@EventListener", "@KafkaListener", "@RabbitListener", "@JmsListener", "@Retryable")),
    ("kt", "ktor", ("routing {", "embeddedServer", "Application.module")),
    ("go", "gin", ("gin.Context", "gin.Default()", "gin.New()")),
    ("go", "echo", ("echo.Context", "echo.New()")),
    ("go", "fiber", ("fiber.Ctx", "fiber.New()")),
    ("rs", "actix-web", ("#[get(", "#[post(", "#[actix_web", "HttpServer::new")),
    ("rs", "axum", ("Router::new", "axum::extract")),
    ("rs", "rocket", ("#[launch]",)),
]
#: Extensions of a family.
FAMILIES = {"js": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte"), "py": ("py",), "java": ("java",), "kt": ("kt", "kts"), "go": ("go",), "rs": ("rs",)}


def register_framework(family: str, name: str, marks: Sequence[str], first: bool = False) -> None:
    """One more framework; a family that isn't known yet is an extension of its own."""
    if not marks:
        raise ValueError("a framework needs marks")
    FAMILIES.setdefault(family, (family,))
    entry = (family, name, tuple(marks))
    if entry not in FRAMEWORKS:
        FRAMEWORKS.insert(0 if first else len(FRAMEWORKS), entry)


def framework_hint(path: Column, text: Column) -> Column:
    """The framework a file belongs to, by its path or else by its whole text; null for none."""
    low, ext, out = F.lower(F.coalesce(text, F.lit(""))), paths.extension(path), F
    for name, where in FRAMEWORK_PATHS:
        out = out.when(path.rlike(where), name)
    for family, name, marks in FRAMEWORKS:
        test = F.lit(False)
        for m in marks:
            test |= F.contains(low, F.lit(m.lower()))
        out = out.when(ext.isin(*FAMILIES[family]) & test, name)
    return out.otherwise(F.lit(None))


#: Templates that projects are started from. Names of files that only they have, in lower case.
SCAFFOLD_NAMES = {
    "scaffold-ruoyi": (
        "abstractquartzjob.java quartzdisallowconcurrentexecution.java jobinvokeutil.java xsshttpservletrequestwrapper.java repeatsubmitinterceptor.java "
        "datalscopeaspect.java sensitivejsonserializer.java servletutils.java loginuser.java sysuser.java sysrole.java sysmenu.java sysdept.java syspost.java "
        "sysdictdata.java sysdicttype.java sysconfig.java sysnotice.java sysoperlog.java syslogininfor.java"
    ).split(),
    "scaffold-vue-admin": "ruoyi.js permission.js validate.js".split(),
}


def scaffold(path: Column) -> Column:
    """The template that a file comes from, by its name, or by its place and kind; null for none."""
    base, out = F.lower(paths.basename(path)), F
    for name, own in SCAFFOLD_NAMES.items():
        out = out.when(base.isin(*own), name)
    low = F.lower(path)
    out = out.when(low.contains("ruoyi") & base.rlike(r"(constants|utils|status)\.java$"), "scaffold-ruoyi")
    out = out.when((low.contains("/ruoyi/") & base.rlike(r"\.(js|ts|vue)$")) | (low.contains("/generator/") & base.rlike(r"\.(js|ts)$")), "scaffold-vue-admin")
    return out.otherwise(F.lit(None))


def load_config(text: str | None) -> dict:
    """A JSON configuration with defaults; unknown keys and wrong types are refused."""
    out = {"directories": {}, "entries": [], "ignore": {"findings": []}, "boundaries": [], "exclude": []}
    given = json.loads(text) if text else {}
    if not isinstance(given, dict):
        raise ValueError("a configuration is an object")
    for key, value in given.items():
        if key not in out or not isinstance(value, type(out[key])):
            raise ValueError(f"unknown or wrong setting: {key}")
        out[key] = value
    for value in out["directories"].values():
        if value not in ("active", "reference", "archive", "generated"):
            raise ValueError(f"unknown directory role: {value}")
    return out


def not_ignored(findings: DataFrame, ids: Sequence[str], column: str = "id") -> DataFrame:
    """Findings whose id isn't on the configured list."""
    return findings.filter(~F.col(column).isin(*ids)) if ids else findings
