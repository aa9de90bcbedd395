"""Pattern libraries: (type, regular expression, description) by language and role."""

from __future__ import annotations

from functools import cache
from re import _parser, match

# Untrusted sources in Go, in order.
GO_SOURCES = (
    ("http_body", r"(?:r|req|request)\.Body", "HTTP request body"),
    ("json_decode", r"json\.(?:NewDecoder|Unmarshal)\s*\(", "JSON decode (origin-agnostic)"),
    ("http_body", r"ioutil\.ReadAll\s*\(\s*(?:r|req|request)\.Body", "Read all from request body"),
    ("http_body", r"io\.ReadAll\s*\(\s*(?:r|req|request)\.Body", "Read all from request body"),
    ("http_body", r"c\.(?:Body|BodyParser|Bind)\s*\(", "Fiber body binding"),
    ("http_query", r"(?:r|req|request)\.URL\.Query\s*\(\)", "URL query parameters"),
    ("http_query", r"(?:r|req|request)\.FormValue\s*\(", "Form value from request"),
    ("http_query", r"(?:r|req|request)\.Form\.Get\s*\(", "Form.Get from request"),
    ("http_query", r"c\.Query\s*\(", "Fiber query parameter"),
    ("http_query", r"c\.QueryParam\s*\(", "Echo query parameter"),
    ("http_query", r"(?:r|req|request)\.Cookie\s*\(", "HTTP cookie value"),
    ("http_query", r"c\.Cookie\s*\(", "Framework cookie value"),
    ("http_query", r"c\.(?:GetQuery|QueryArray|PostForm|PostFormArray)\s*\(", "Gin parameter extraction"),
    ("http_header", r"(?:r|req|request)\.Header\.Get\s*\(", "HTTP header value"),
    ("http_header", r"(?:r|req|request)\.Header\[", "HTTP header access"),
    ("http_header", r"""c\.Get\s*\(\s*["']""", "Fiber header get"),
    ("http_path", r"(?:mux\.)?Vars\s*\(\s*(?:r|req|request)\s*\)", "URL path variable (gorilla/mux)"),
    ("http_path", r"chi\.URLParam\s*\(", "URL parameter (chi)"),
    ("http_path", r"c\.Params\s*\(", "Fiber path parameter"),
    ("http_path", r"c\.Param\s*\(", "Echo/Gin path parameter"),
    ("env_var", r"os\.Getenv\s*\(", "Environment variable read"),
    ("env_var", r"os\.LookupEnv\s*\(", "Environment variable lookup"),
    ("env_var", r"viper\.(?:Get|GetString|GetInt)\s*\(", "Viper config read"),
    ("file_read", r"os\.(?:Open|ReadFile)\s*\(", "File open/read"),
    ("file_read", r"ioutil\.ReadFile\s*\(", "File read (ioutil)"),
    ("file_read", r"io\.(?:ReadAll|Copy)\s*\(", "IO read operation"),
    ("file_read", r"bufio\.NewReader\s*\(", "Buffered reader"),
    ("database", r"\.Query(?:Row|Context)?\s*\(", "Database query result"),
    ("database", r"\.Scan\s*\(", "Database scan result"),
    ("database", r"\.Find(?:One|All|By)?\s*\(", "ORM find operation"),
    ("database", r"\.First\s*\(", "GORM first query"),
    ("database", r"collection\.(?:Find|FindOne)\s*\(", "MongoDB query"),
    ("external_api", r"http\.(?:Get|Post|Do)\s*\(", "HTTP client request"),
    ("external_api", r"client\.(?:Get|Post|Do)\s*\(", "HTTP client call"),
    ("external_api", r"\.(?:Response|Body)\.", "HTTP response body"),
    ("user_input", r"bufio\.NewScanner\s*\(\s*os\.Stdin", "Stdin scanner"),
    ("user_input", r"fmt\.Scan(?:f|ln)?\s*\(", "Console input"),
    ("user_input", r"os\.Args(?:\[[^\]]+\])?", "Command line arguments"),
    ("http_body", r"grpc\.(?:UnaryServerInterceptor|StreamServerInterceptor)", "gRPC interceptor input"),
)

# Sensitive sinks in Go, in order.
GO_SINKS = (
    ("database", r"\.Exec(?:Context)?\s*\(", "SQL exec (potential injection)"),
    ("database", r"\.Query(?:Row)?(?:Context)?\s*\([^,]*\+", "SQL query with concatenation"),
    ("database", r"fmt\.Sprintf\s*\([^)]*(?:SELECT|INSERT|UPDATE|DELETE)", "SQL string formatting"),
    ("database", r"collection\.(?:InsertOne|UpdateOne|DeleteOne)\s*\(", "MongoDB write operation"),
    ("command_exec", r"exec\.Command\s*\(", "OS command execution"),
    ("command_exec", r"exec\.CommandContext\s*\(", "OS command with context"),
    ("command_exec", r"os\.StartProcess\s*\(", "OS process start"),
    ("command_exec", r"syscall\.Exec\s*\(", "Syscall exec"),
    ("redirect", r"(?:net\.Dial|net\.DialTimeout|http\.Get|http\.Post|http\.NewRequest(?:WithContext)?)\s*\(", "Outbound network request"),
    ("http_response", r"(?:w|rw|writer|response)\.Write\s*\(", "HTTP response write"),
    ("http_response", r"(?:w|rw|writer|response)\.WriteString\s*\(", "HTTP response write string"),
    ("http_response", r"fmt\.Fprint(?:f|ln)?\s*\(\s*(?:w|rw|writer)", "Printf to response writer"),
    ("http_response", r"json\.NewEncoder\s*\(\s*(?:w|rw|writer)", "JSON encode to response"),
    ("http_response", r"c\.(?:JSON|Send|Write|Status)\s*\(", "Fiber response"),
    ("http_response", r"c\.(?:String|HTML|XML)\s*\(", "Echo/Gin response"),
    ("http_response", r"(?:w|rw|writer|response)\.Header\s*\(\)\.Set\s*\(", "HTTP response header write"),
    ("logging", r"log\.(?:Print|Printf|Println|Fatal|Fatalf)\s*\(", "Standard log output"),
    ("logging", r"logger\.(?:Info|Warn|Error|Debug|Fatal)(?:f|w)?\s*\(", "Structured logger"),
    ("logging", r"zap\.(?:L|S)\(\)\.(?:Info|Warn|Error|Debug)\s*\(", "Zap logger"),
    ("logging", r"logrus\.(?:Info|Warn|Error|Debug|Fatal)(?:f)?\s*\(", "Logrus logger"),
    ("logging", r"slog\.(?:Info|Warn|Error|Debug)\s*\(", "Slog logger"),
    ("file_write", r"os\.(?:WriteFile|Create)\s*\(", "File write/create"),
    ("file_write", r"ioutil\.WriteFile\s*\(", "File write (ioutil)"),
    ("file_write", r"(?:f|file)\.Write(?:String)?\s*\(", "File handle write"),
    ("file_write", r"io\.(?:Copy|WriteString)\s*\(", "IO write operation"),
    ("file_write", r"filepath\.Join\s*\(", "Path construction"),
    ("file_write", r"os\.Open\s*\(", "File open"),
    ("template", r"template\.(?:HTML|JS|CSS)\s*\(", "Template type conversion"),
    ("template", r"\.Execute(?:Template)?\s*\(", "Template execution"),
    ("template", r"html/template.*Execute", "HTML template execute"),
    ("template", r"json\.Unmarshal\s*\(", "JSON deserialization"),
    ("redirect", r"http\.Redirect\s*\(", "HTTP redirect"),
    ("redirect", r"c\.Redirect\s*\(", "Fiber/Echo redirect"),
    ("redirect", r"""(?:w|rw)\.Header\(\)\.Set\s*\(\s*"Location\"""", "Location header redirect"),
)

# Assignments in Go whose result may be nil, in order.
GO_NIL = (
    r"(\w+)\s*(?:,\s*(?:ok|_))?\s*:?=\s*\w+\[",
    r"(\w+)\s*,\s*err\s*:?=\s*(?:db|tx|conn)\.(?:Query|QueryRow|Exec)",
    r"(\w+)\s*(?:,\s*(?:ok|_))?\s*:?=\s*\w+\.\(\w+\)",
    r"json\.Unmarshal\s*\([^,]+,\s*&?(\w+)\)",
    r"(\w+)\s*:?=\s*\*?\w+\.(?:Find|Get|Load|Lookup)\w*\s*\(",
    r"(\w+)\s*,\s*ok\s*:?=\s*\w+\.\(interface\{\}\)",
    r"(\w+)\s*(?:,\s*(?:ok|_))?\s*:?=\s*(?:ctx|context)\.Value\s*\(",
    r"(\w+)\s*(?:,\s*(?:ok|_))?\s*:?=\s*<-\s*\w+",
)

# Untrusted sources in Python, in order.
PYTHON_SOURCES = (
    ("http_body", r"request\.get_json\s*\(\s*\)", "request.get_json()"),
    ("http_body", r"request\.json\b", "request.json"),
    ("http_body", r"request\.data\b", "request.data"),
    ("http_body", r"request\.form\b", "request.form"),
    ("http_body", r"request\.POST\b", "request.POST"),
    ("http_body", r"await\s+request\.json\s*\(\s*\)", "await request.json()"),
    ("http_body", r"await\s+request\.body\s*\(\s*\)", "await request.body()"),
    ("http_query", r"request\.args\.get\s*\(", "request.args.get"),
    ("http_query", r"request\.GET\.get\s*\(", "request.GET.get"),
    ("http_query", r"request\.GET\[", "request.GET[]"),
    ("http_query", r"request\.query_params\.get\s*\(", "request.query_params.get"),
    ("http_query", r"Query\s*\(", "Query()"),
    ("http_header", r"request\.headers\.get\s*\(", "request.headers.get"),
    ("http_header", r"request\.headers\[", "request.headers[]"),
    ("http_header", r"request\.META\.get\s*\(", "request.META.get"),
    ("http_header", r"Header\s*\(", "Header()"),
    ("http_path", r"@app\.route\s*\([^)]*<([^>]+)>", "route_param"),
    ("http_path", r"@router\.(get|post|put|delete|patch)\s*\([^)]*\{([^}]+)\}", "path_param"),
    ("http_path", r"Path\s*\(", "Path()"),
    ("env_var", r"os\.getenv\s*\(", "os.getenv"),
    ("env_var", r"os\.environ\.get\s*\(", "os.environ.get"),
    ("env_var", r"os\.environ\[", "os.environ[]"),
    ("env_var", r"environ\.get\s*\(", "environ.get"),
    ("file_read", r"open\s*\([^)]*\)\.read\s*\(", "open().read()"),
    ("file_read", r"\.read_text\s*\(\s*\)", ".read_text()"),
    ("file_read", r"\.read_bytes\s*\(\s*\)", ".read_bytes()"),
    ("file_read", r"Path\s*\([^)]*\)\.read", "Path().read"),
    ("file_read", r"with\s+open\s*\(", "with open()"),
    ("database", r"\.execute\s*\(", ".execute()"),
    ("database", r"\.fetchone\s*\(\s*\)", ".fetchone()"),
    ("database", r"\.fetchall\s*\(\s*\)", ".fetchall()"),
    ("database", r"\.fetchmany\s*\(", ".fetchmany()"),
    ("database", r"cursor\.", "cursor operation"),
    ("database", r"\.objects\.raw\s*\(", ".objects.raw()"),
    ("database", r"\.objects\.get\s*\(", ".objects.get()"),
    ("database", r"\.objects\.filter\s*\(", ".objects.filter()"),
    ("external_api", r"requests\.get\s*\(", "requests.get"),
    ("external_api", r"requests\.post\s*\(", "requests.post"),
    ("external_api", r"requests\.put\s*\(", "requests.put"),
    ("external_api", r"requests\.delete\s*\(", "requests.delete"),
    ("external_api", r"requests\.patch\s*\(", "requests.patch"),
    ("external_api", r"httpx\.(get|post|put|delete|patch)\s*\(", "httpx request"),
    ("external_api", r"aiohttp\.ClientSession\s*\(", "aiohttp session"),
    ("external_api", r"await\s+session\.(get|post|put|delete|patch)\s*\(", "aiohttp request"),
    ("external_api", r"urllib\.request\.urlopen\s*\(", "urllib.request.urlopen"),
)

# Sensitive sinks in Python, in order.
PYTHON_SINKS = (
    ("database", r"cursor\.execute\s*\([^)]*%", "cursor.execute with % formatting"),
    ("database", r"cursor\.execute\s*\([^)]*\.format\s*\(", "cursor.execute with .format()"),
    ("database", r"""cursor\.execute\s*\(\s*f["\']""", "cursor.execute with f-string"),
    ("database", r"\.raw\s*\(", ".raw() query"),
    ("database", r"\.extra\s*\(", ".extra() query"),
    ("database", r"connection\.execute\s*\(", "connection.execute"),
    ("database", r"RawSQL\s*\(", "RawSQL()"),
    ("command_exec", r"subprocess\.run\s*\(", "subprocess.run"),
    ("command_exec", r"subprocess\.call\s*\(", "subprocess.call"),
    ("command_exec", r"subprocess\.Popen\s*\(", "subprocess.Popen"),
    ("command_exec", r"os\.system\s*\(", "os.system"),
    ("command_exec", r"os\.popen\s*\(", "os.popen"),
    ("command_exec", r"os\.exec[lv]p?e?\s*\(", "os.exec*"),
    ("command_exec", r"\beval\s*\(", "eval()"),
    ("command_exec", r"\bexec\s*\(", "exec()"),
    ("command_exec", r"compile\s*\(", "compile()"),
    ("command_exec", r"__import__\s*\(", "__import__()"),
    ("http_response", r"jsonify\s*\(", "jsonify()"),
    ("http_response", r"make_response\s*\(", "make_response()"),
    ("http_response", r"render_template\s*\(", "render_template()"),
    ("http_response", r"HttpResponse\s*\(", "HttpResponse()"),
    ("http_response", r"JsonResponse\s*\(", "JsonResponse()"),
    ("http_response", r"Response\s*\(", "Response()"),
    ("http_response", r"return\s+\{", "return dict"),
    ("logging", r"logging\.(debug|info|warning|error|critical)\s*\(", "logging.*()"),
    ("logging", r"logger\.(debug|info|warning|error|critical)\s*\(", "logger.*()"),
    ("logging", r"\bprint\s*\(", "print()"),
    ("file_write", r"""open\s*\([^)]*["\'][wa][+]?["\']""", "open() write mode"),
    ("file_write", r"\.write\s*\(", ".write()"),
    ("file_write", r"\.write_text\s*\(", ".write_text()"),
    ("file_write", r"\.write_bytes\s*\(", ".write_bytes()"),
    ("file_write", r"shutil\.copy", "shutil.copy"),
    ("file_write", r"shutil\.move", "shutil.move"),
    ("template", r"render_template\s*\(", "render_template()"),
    ("template", r"render_template_string\s*\(", "render_template_string()"),
    ("template", r"Template\s*\(", "Template()"),
    ("template", r"Environment\s*\(", "Jinja2 Environment()"),
    ("template", r"Markup\s*\(", "Markup()"),
    ("redirect", r"redirect\s*\(", "redirect()"),
    ("redirect", r"HttpResponseRedirect\s*\(", "HttpResponseRedirect()"),
    ("redirect", r"RedirectResponse\s*\(", "RedirectResponse()"),
    ("ssrf", r"requests\.(get|post|put|delete|patch)\s*\(", "requests outbound call"),
    ("ssrf", r"httpx\.(get|post|put|delete|patch)\s*\(", "httpx outbound call"),
    ("ssrf", r"urllib\.request\.urlopen\s*\(", "urllib outbound call"),
)

# Untrusted sources in TypeScript, in order.
TYPESCRIPT_SOURCES = (
    ("http_body", r"req\.body\b", "req.body"),
    ("http_body", r"request\.body\b", "request.body"),
    ("http_body", r"ctx\.request\.body\b", "ctx.request.body"),
    ("http_body", r"ctx\.body\b", "ctx.body"),
    ("http_body", r"event\.body\b", "event.body"),
    ("http_body", r"(?:req|request|ctx|context)\.json\s*\(\s*\)", "req.json()"),
    ("http_query", r"req\.query\b", "req.query"),
    ("http_query", r"req\.params\b", "req.params"),
    ("http_query", r"request\.query\b", "request.query"),
    ("http_query", r"ctx\.query\b", "ctx.query"),
    ("http_query", r"ctx\.params\b", "ctx.params"),
    ("http_query", r"searchParams\.get\s*\(", "searchParams.get"),
    ("http_query", r"URLSearchParams\s*\(", "URLSearchParams"),
    ("http_query", r"url\.searchParams\b", "url.searchParams"),
    ("http_header", r"req\.headers\b", "req.headers"),
    ("http_header", r"request\.headers\b", "request.headers"),
    ("http_header", r"ctx\.headers\b", "ctx.headers"),
    ("http_header", r"ctx\.request\.headers\b", "ctx.request.headers"),
    ("http_header", r"headers\.get\s*\(", "headers.get"),
    ("env_var", r"process\.env\b", "process.env"),
    ("env_var", r"Deno\.env\.get\s*\(", "Deno.env.get"),
    ("env_var", r"Bun\.env\b", "Bun.env"),
    ("file_read", r"fs\.readFile\s*\(", "fs.readFile"),
    ("file_read", r"fs\.readFileSync\s*\(", "fs.readFileSync"),
    ("file_read", r"readFile\s*\(", "readFile"),
    ("file_read", r"readFileSync\s*\(", "readFileSync"),
    ("file_read", r"Deno\.readTextFile\s*\(", "Deno.readTextFile"),
    ("file_read", r"Bun\.file\s*\(", "Bun.file"),
    ("database", r"(?:db|conn|tx|pool|client|connection)\.query\s*\(", "db.query()"),
    ("database", r"(?:db|conn|tx|pool|client|connection|repo|repository|model|collection)\.findOne\s*\(", "db.findOne()"),
    ("database", r"(?:db|conn|tx|pool|client|connection|repo|repository|model|collection)\.findFirst\s*\(", "db.findFirst()"),
    ("database", r"(?:db|conn|tx|pool|client|connection|repo|repository|model|collection)\.findUnique\s*\(", "db.findUnique()"),
    ("database", r"(?:db|conn|tx|pool|client|connection|repo|repository|model|collection)\.findMany\s*\(", "db.findMany()"),
    ("database", r"(?:db|conn|tx|pool|client|connection|repo|repository|model|collection)\.aggregate\s*\(", "db.aggregate()"),
    ("database", r"prisma\.\w+\.", "prisma query"),
    ("database", r"\bdb\.\w+\.", "db query"),
    ("external_api", r"\bfetch\s*\(", "fetch()"),
    ("external_api", r"axios\.(get|post|put|delete|patch)\s*\(", "axios request"),
    ("external_api", r"axios\s*\(", "axios()"),
    ("external_api", r"got\s*\(", "got()"),
    ("external_api", r"got\.(get|post|put|delete|patch)\s*\(", "got request"),
    ("external_api", r"http\.request\s*\(", "http.request"),
    ("external_api", r"https\.request\s*\(", "https.request"),
)

# Sensitive sinks in TypeScript, in order.
TYPESCRIPT_SINKS = (
    ("database", r"\.query\s*\(\s*`", ".query() with template literal"),
    ("database", r"""\.query\s*\(\s*[\"'][^\"']*\$\{""", ".query() with interpolation"),
    ("database", r"\.exec\s*\(", ".exec()"),
    ("database", r"\.raw\s*\(", ".raw()"),
    ("database", r"\$queryRaw\s*`", "$queryRaw template"),
    ("database", r"\$executeRaw\s*`", "$executeRaw template"),
    ("database", r"\.rawQuery\s*\(", ".rawQuery()"),
    ("command_exec", r"\bexec\s*\(", "exec()"),
    ("command_exec", r"\bexecSync\s*\(", "execSync()"),
    ("command_exec", r"\bspawn\s*\(", "spawn()"),
    ("command_exec", r"\bspawnSync\s*\(", "spawnSync()"),
    ("command_exec", r"\beval\s*\(", "eval()"),
    ("command_exec", r"new\s+Function\s*\(", "new Function()"),
    ("command_exec", r"vm\.runInContext\s*\(", "vm.runInContext"),
    ("command_exec", r"vm\.runInNewContext\s*\(", "vm.runInNewContext"),
    ("command_exec", r"vm\.Script\s*\(", "vm.Script"),
    ("command_exec", r"child_process\.", "child_process"),
    ("http_response", r"res\.send\s*\(", "res.send()"),
    ("http_response", r"res\.json\s*\(", "res.json()"),
    ("http_response", r"res\.write\s*\(", "res.write()"),
    ("http_response", r"res\.end\s*\(", "res.end()"),
    ("http_response", r"ctx\.body\s*=", "ctx.body ="),
    ("http_response", r"response\.send\s*\(", "response.send()"),
    ("http_response", r"response\.json\s*\(", "response.json()"),
    ("http_response", r"return\s+Response\s*\(", "return Response()"),
    ("http_response", r"new\s+Response\s*\(", "new Response()"),
    ("logging", r"console\.(log|warn|error|info|debug)\s*\(", "console.*()"),
    ("logging", r"logger\.(log|warn|error|info|debug)\s*\(", "logger.*()"),
    ("logging", r"winston\.(log|warn|error|info|debug)\s*\(", "winston.*()"),
    ("logging", r"pino\.(log|warn|error|info|debug)\s*\(", "pino.*()"),
    ("file_write", r"fs\.writeFile\s*\(", "fs.writeFile"),
    ("file_write", r"fs\.writeFileSync\s*\(", "fs.writeFileSync"),
    ("file_write", r"writeFile\s*\(", "writeFile"),
    ("file_write", r"writeFileSync\s*\(", "writeFileSync"),
    ("file_write", r"fs\.appendFile\s*\(", "fs.appendFile"),
    ("file_write", r"Deno\.writeTextFile\s*\(", "Deno.writeTextFile"),
    ("file_write", r"Bun\.write\s*\(", "Bun.write"),
    ("template", r"\.render\s*\(", ".render()"),
    ("template", r"dangerouslySetInnerHTML\s*=", "dangerouslySetInnerHTML"),
    ("template", r"\.innerHTML\s*=", ".innerHTML ="),
    ("template", r"\.outerHTML\s*=", ".outerHTML ="),
    ("template", r"document\.write\s*\(", "document.write"),
    ("template", r"insertAdjacentHTML\s*\(", "insertAdjacentHTML"),
    ("redirect", r"res\.redirect\s*\(", "res.redirect()"),
    ("redirect", r"response\.redirect\s*\(", "response.redirect()"),
    ("redirect", r"ctx\.redirect\s*\(", "ctx.redirect()"),
    ("redirect", r"window\.location\s*=", "window.location ="),
    ("redirect", r"location\.href\s*=", "location.href ="),
    ("redirect", r"location\.assign\s*\(", "location.assign()"),
    ("redirect", r"location\.replace\s*\(", "location.replace()"),
    ("ssrf", r"\bfetch\s*\(", "fetch() outbound call"),
    ("ssrf", r"axios\.(get|post|put|delete|patch)\s*\(", "axios outbound call"),
    ("ssrf", r"axios\s*\(", "axios() outbound call"),
    ("ssrf", r"got\s*\(", "got() outbound call"),
    ("ssrf", r"http\.request\s*\(", "http.request outbound call"),
    ("ssrf", r"https\.request\s*\(", "https.request outbound call"),
)

# Expressions in TypeScript that may be null, as (expression, description, origin), in order.
TYPESCRIPT_NULL = (
    (r"\.findOne\s*\(", ".findOne()", "database_query"),
    (r"\.findFirst\s*\(", ".findFirst()", "database_query"),
    (r"\.findUnique\s*\(", ".findUnique()", "database_query"),
    (r"\.get\s*\([^)]*\)\s*(?!\!)", ".get() without assertion", "map_lookup"),
    (r"Map\.prototype\.get\s*\(", "Map.get()", "map_lookup"),
    (r"\.get\s*<", "Map.get<>()", "map_lookup"),
    (r"JSON\.parse\s*\(", "JSON.parse()", "json_parse"),
    (r"JSON\.parseAsync\s*\(", "JSON.parseAsync()", "json_parse"),
    (r"\?\.", "optional chaining", "optional_chain"),
    (r"\?\?\s*", "nullish coalescing", "nullish_coalesce"),
    (r"\bas\s+\w+(?:\s*\|\s*null)?", "type assertion", "type_assertion"),
    (r"<\w+>", "type cast", "type_cast"),
    (r"!\s*[;,\)]", "non-null assertion", "non_null_assertion"),
    (r"await\s+\w+\.catch\s*\(", "caught promise", "promise_catch"),
)

# What counts as sanitizing, by sink type.
PYTHON_SANITIZERS = {
    "database": (r"execute\s*\([^,]+,\s*[\[\(]", r"\?\s*,"),
    "command_exec": (r"shlex\.quote", r"subprocess\.\w+\([^)]*shell\s*=\s*False"),
    "http_response": ("escape", r"html\.escape", "markupsafe", "bleach"),
    "template": (r"autoescape\s*=\s*True", r"\|safe\b"),
}
TYPESCRIPT_SANITIZERS = {
    "database": (r"\$\d+", r"\?", r"prepare\("),
    "command_exec": (r"shell:\s*false",),
    "http_response": ("escapeHtml", "sanitize", "DOMPurify", "xss"),
    "template": ("textContent", "createTextNode"),
}

#: By language: untrusted sources, sensitive sinks.
LIBRARY = {"go": (GO_SOURCES, GO_SINKS), "python": (PYTHON_SOURCES, PYTHON_SINKS), "typescript": (TYPESCRIPT_SOURCES, TYPESCRIPT_SINKS)}

# Calls in Go that sanitize what they return, in order; matched in any case.
GO_SANITIZERS = (
    r"html\.EscapeString",
    r"url\.QueryEscape",
    r"url\.PathEscape",
    r"filepath\.(?:Clean|Base)",
    r"strconv\.(?:Atoi|ParseInt|ParseFloat|ParseBool)",
    r"template\.(?:HTMLEscapeString|JSEscapeString)",
    r"sql\.Named",
    r"pgx\.NamedArgs",
    r"bluemonday\.(?:UGCPolicy|StrictPolicy|StricterPolicy|NewPolicy)\(\)\.Sanitize",
    r"\.Sanitize(?:Bytes|Reader)?\s*\(",
    r"validator\.New\s*\(\)",
    r"(?:validate|validator|v)\.(?:Struct|StructCtx|Var|VarCtx|StructFiltered|StructPartial|StructExcept)\s*\(",
    r"govalidator\.(?:Is[A-Z]\w*|ValidateStruct|ValidateMap|Trim|Escape|SafeFileName|WhiteList|BlackList|StripLow)\s*\(",
)
GO_SANITIZER = "(?i)(?:" + "|".join(GO_SANITIZERS) + ")"


@cache
def required_literal(pattern: str) -> str:
    """The longest run of characters that every match of a case-sensitive expression holds, "" if none is plain."""
    best = run = ""
    for what, value in _parser.parse(pattern):
        run = run + chr(value) if what is _parser.LITERAL else ""
        best = max(best, run, key=len)
    return "" if match(r"\(\?[a-zA-Z]", pattern) or len(best) < 2 else best
