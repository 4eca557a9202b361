"""The built-in rules, in their fixed order; order breaks ties of priority."""

#: Id, domain, action, provider, priority, callee pattern of a function call, external calls only.
DOMAIN_RULES = (
    ("db-write-dynamodb", "Database", "Write", "dynamodb", 10, r"(?i)dynamodb.*\.(put|update|delete|batchWrite)", None),
    ("db-read-dynamodb", "Database", "Read", "dynamodb", 10, r"(?i)dynamodb.*\.(get|query|scan|batchGet)", None),
    ("db-kysely-read", "Database", "Read", "kysely", 10, r"(?i)\.(selectFrom|selectAll|executeTakeFirst|executeTakeFirstOrThrow)$", None),
    ("db-kysely-write", "Database", "Write", "kysely", 10, r"(?i)\.(insertInto|updateTable|deleteFrom)$", None),
    ("db-write-sql", "Database", "Write", "sql", 5, r"(?i)\.(insert|update|delete|execute|run)$", None),
    ("db-read-sql", "Database", "Read", "sql", 5, r"(?i)\.(select|query|find|all|first|get)$", None),
    ("db-prisma-write", "Database", "Write", "prisma", 10, r"(?i)prisma\.\w+\.(create|update|upsert|delete|deleteMany|updateMany)", None),
    ("db-prisma-read", "Database", "Read", "prisma", 10, r"(?i)prisma\.\w+\.(findUnique|findFirst|findMany|count|aggregate)", None),
    ("payment-stripe-charge", "Payment", "Charge", "stripe", 20, r"(?i)stripe\.(charges|paymentIntents)\.(create|confirm)", None),
    ("payment-stripe-refund", "Payment", "Refund", "stripe", 20, r"(?i)stripe\.refunds\.create", None),
    ("payment-stripe-subscription", "Payment", "Subscription", "stripe", 20, r"(?i)stripe\.subscriptions\.(create|update|cancel)", None),
    ("auth-jwt-sign", "Auth", "TokenCreate", None, 15, r"(?i)jwt\.(sign|encode)", None),
    ("auth-jwt-verify", "Auth", "TokenVerify", None, 15, r"(?i)jwt\.(verify|decode)", None),
    ("auth-bcrypt-hash", "Auth", "PasswordHash", None, 15, r"(?i)bcrypt\.(hash|hashSync)", None),
    ("auth-bcrypt-compare", "Auth", "PasswordVerify", None, 15, r"(?i)bcrypt\.(compare|compareSync)", None),
    ("auth-cognito", "Auth", "CognitoAuth", "aws-cognito", 20, r"(?i)cognito.*\.(adminInitiateAuth|initiateAuth|signUp|confirmSignUp)", None),
    ("http-fetch", "HTTP", "Request", None, 5, r"^fetch$", True),
    ("http-axios", "HTTP", "Request", None, 10, r"(?i)axios\.(get|post|put|patch|delete|request)", True),
    ("api-trpc-mutation", "API", "Mutation", None, 15, r"(?i)procedure\.mutation$", None),
    ("api-trpc-query", "API", "Query", None, 15, r"(?i)procedure\.query$", None),
    ("api-trpc-procedure", "API", "Procedure", None, 15, r"(?i)\.procedure$", None),
    ("messaging-sqs-send", "Messaging", "Send", "aws-sqs", 15, r"(?i)sqs.*\.(sendMessage|sendMessageBatch)", None),
    ("messaging-sqs-receive", "Messaging", "Receive", "aws-sqs", 15, r"(?i)sqs.*\.(receiveMessage)", None),
    ("messaging-sns-publish", "Messaging", "Publish", "aws-sns", 15, r"(?i)sns.*\.(publish)", None),
    ("messaging-eventbridge", "Messaging", "Publish", "aws-eventbridge", 15, r"(?i)eventbridge.*\.(putEvents)", None),
    ("storage-s3-put", "Storage", "Write", "aws-s3", 15, r"(?i)s3.*\.(putObject|upload)", None),
    ("storage-s3-get", "Storage", "Read", "aws-s3", 15, r"(?i)s3.*\.(getObject)", None),
    ("storage-fs-write", "Storage", "Write", "filesystem", 5, r"(?i)fs.*\.(writeFile|appendFile|createWriteStream)", None),
    ("storage-fs-read", "Storage", "Read", "filesystem", 5, r"(?i)fs.*\.(readFile|createReadStream)", None),
    ("logging-console", "Observability", "Log", "console", 1, r"console\.(log|info|warn|error|debug)", None),
    ("logging-datadog", "Observability", "Metric", "datadog", 10, r"(?i)dd-trace|datadog", None),
)

#: Id, path pattern (either case), container, layer, tags, priority.
GROUPING_RULES = (
    ("grouping-parsers", r"parsers?[\/\-]", "Analysis Layer", "domain", ("parser", "ast"), 20),
    ("grouping-analyzers", r"analyz(er|e|ing)", "Analysis Layer", "domain", ("analyzer",), 20),
    ("grouping-semantic-resolver", r"semantic|resolver|symbols?", "Analysis Layer", "domain", ("semantic",), 15),
    ("grouping-extractors", r"extract(or|ion)?", "Analysis Layer", "domain", ("extractor",), 15),
    ("grouping-duckdb", r"duckdb|duck-?db", "Storage Layer", "infrastructure", ("database", "duckdb"), 25),
    ("grouping-parquet", r"parquet", "Storage Layer", "infrastructure", ("storage", "parquet"), 25),
    ("grouping-seeds", r"seeds?[\/\-]|seed-?writer|seed-?reader", "Storage Layer", "infrastructure", ("seed",), 20),
    ("grouping-cache", r"cache", "Storage Layer", "infrastructure", ("cache",), 15),
    ("grouping-hub", r"hub|central", "Federation Layer", "application", ("hub", "federation"), 25),
    ("grouping-registry", r"registry|manifest", "Federation Layer", "application", ("registry",), 20),
    ("grouping-federation-client", r"federat(e|ion)|cross-?repo", "Federation Layer", "application", ("federation", "client"), 15),
    ("grouping-mcp-tools", r"mcp|tools?[\/\-]", "API Layer", "presentation", ("mcp", "api"), 20),
    ("grouping-cli-commands", r"commands?[\/\-]", "API Layer", "presentation", ("cli", "command"), 20),
    ("grouping-handlers", r"handlers?[\/\-]", "API Layer", "presentation", ("handler",), 15),
    ("grouping-rule-engine", r"rule-?engine", "Rules Layer", "domain", ("rules", "engine"), 25),
    ("grouping-builtin-rules", r"builtin-?rules|domain-?rules", "Rules Layer", "domain", ("rules", "builtin"), 20),
    ("grouping-rules-generic", r"\/rules\/", "Rules Layer", "domain", ("rules",), 10),
    ("grouping-c4-generator", r"c4|diagram", "Views Layer", "presentation", ("c4", "diagram"), 20),
    ("grouping-views-generic", r"\/views\/", "Views Layer", "presentation", ("views",), 10),
)

#: Id, level, priority, conditions that must all hold.  Patterns match in either case.
SIGNIFICANCE_RULES = (
    ("sig-payment-operations", "critical", 100, {"domain": "Payment"}),
    ("sig-auth-operations", "critical", 100, {"domain": "Auth"}),
    ("sig-high-dependents", "critical", 90, {"min_dependents": 5}),
    ("sig-exported-api", "critical", 85, {"exported": True, "kinds": ("function", "class")}),
    ("sig-api-endpoints", "critical", 80, {"domain": "API"}),
    ("sig-database-operations", "important", 60, {"domain": "Database"}),
    ("sig-messaging-operations", "important", 60, {"domain": "Messaging"}),
    ("sig-storage-operations", "important", 55, {"domain": "Storage"}),
    ("sig-http-external", "important", 55, {"domain": "HTTP"}),
    ("sig-moderate-dependents", "important", 50, {"min_dependents": 2}),
    ("sig-utility-files", "minor", 30, {"file": r"util(s|ity|ities)?[\/\-]|helper(s)?[\/\-]"}),
    ("sig-utility-functions", "minor", 25, {"name": r"^(get|set|is|has|format|parse|convert|transform|validate|normalize)"}),
    ("sig-internal-only", "minor", 20, {"exported": False, "kinds": ("function",)}),
    ("sig-type-files", "minor", 20, {"file": r"types?[\/\-]|\.d\.ts$"}),
    ("sig-console-logging", "hidden", 100, {"domain": "Observability", "action": "Log", "console": True}),
    ("sig-test-files", "hidden", 100, {"file": r"\.(test|spec)\.(ts|js)x?$|__tests?__|__mocks?__"}),
    ("sig-debug-code", "hidden", 95, {"file": r"debug[\/\-]"}),
    ("sig-mock-files", "hidden", 95, {"file": r"mock(s)?[\/\-]|\.mock\."}),
    ("sig-example-files", "hidden", 90, {"file": r"example(s)?[\/\-]|demo[\/\-]"}),
    ("sig-generated-files", "hidden", 90, {"file": r"generated[\/\-]|\.generated\."}),
)
