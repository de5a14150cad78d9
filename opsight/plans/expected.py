"""Fixed values as the comparison SQL states them.

They repeat what the operators hold, on purpose and as literals: a wrong code, pattern or
text in an operator must not reach the SQL it is compared with.
"""

EXECUTION_ERROR = 'RUN_EXECUTION_ERROR'
CATEGORIES = [(['INTERNAL_ERROR', 'CLOUD_FAILURE', 'CLUSTER_ERROR', 'DRIVER_ERROR'], '1. Transient / Infra'),
 (['INVALID_RUN_CONFIGURATION',
   'INVALID_CLUSTER_REQUEST',
   'RESOURCE_NOT_FOUND',
   'REPOSITORY_CHECKOUT_FAILED',
   'LIBRARY_INSTALLATION_ERROR',
   'FEATURE_DISABLED'],
  '2. Config / Definition (tech debt)'),
 (['UNAUTHORIZED_ERROR', 'STORAGE_ACCESS_ERROR'], '3. Permissions / Governance'),
 (['MAX_CONCURRENT_RUNS_EXCEEDED',
   'MAX_JOB_QUEUE_SIZE_EXCEEDED',
   'WORKSPACE_RUN_LIMIT_EXCEEDED',
   'CLUSTER_REQUEST_LIMIT_EXCEEDED',
   'MAX_SPARK_CONTEXTS_EXCEEDED'],
  '4. Concurrency / Limits'),
 (['RUN_EXECUTION_ERROR'], '5. Code / Data logic (needs triage)')]
OTHER_CATEGORY = '6. Other / Uncategorized'
LEVERS = {'generic': [(['INTERNAL_ERROR', 'CLOUD_FAILURE', 'CLUSTER_ERROR', 'DRIVER_ERROR'], 'Job retries + serverless (auto-recover)'),
             (['INVALID_RUN_CONFIGURATION',
               'INVALID_CLUSTER_REQUEST',
               'RESOURCE_NOT_FOUND',
               'REPOSITORY_CHECKOUT_FAILED',
               'LIBRARY_INSTALLATION_ERROR',
               'FEATURE_DISABLED'],
              'DABs + CI/CD + serverless (eliminate config drift)'),
             (['UNAUTHORIZED_ERROR', 'STORAGE_ACCESS_ERROR'], 'Unity Catalog governance + service principals'),
             (['MAX_CONCURRENT_RUNS_EXCEEDED',
               'MAX_JOB_QUEUE_SIZE_EXCEEDED',
               'WORKSPACE_RUN_LIMIT_EXCEEDED',
               'CLUSTER_REQUEST_LIMIT_EXCEEDED',
               'MAX_SPARK_CONTEXTS_EXCEEDED'],
              'Orchestration design + serverless elasticity'),
             (['RUN_EXECUTION_ERROR'], 'Lakeflow/DLT expectations + Auto Loader; triage agent for residual')],
 'pipelines': [(['INTERNAL_ERROR', 'CLOUD_FAILURE', 'CLUSTER_ERROR', 'DRIVER_ERROR'],
                'Lakeflow Declarative Pipelines on serverless — automatic retries + managed compute self-heal transient infra'),
               (['INVALID_RUN_CONFIGURATION',
                 'INVALID_CLUSTER_REQUEST',
                 'RESOURCE_NOT_FOUND',
                 'REPOSITORY_CHECKOUT_FAILED',
                 'LIBRARY_INSTALLATION_ERROR',
                 'FEATURE_DISABLED'],
                'Lakeflow Declarative Pipelines + DABs on serverless — no hand-built ADF/cluster config to drift'),
               (['UNAUTHORIZED_ERROR', 'STORAGE_ACCESS_ERROR'],
                'Auto Loader on UC external locations + service principals — one governed ingestion path'),
               (['MAX_CONCURRENT_RUNS_EXCEEDED',
                 'MAX_JOB_QUEUE_SIZE_EXCEEDED',
                 'WORKSPACE_RUN_LIMIT_EXCEEDED',
                 'CLUSTER_REQUEST_LIMIT_EXCEEDED',
                 'MAX_SPARK_CONTEXTS_EXCEEDED'],
                'Lakeflow orchestration replaces ADF triggers — serverless elasticity absorbs concurrency spikes'),
               (['RUN_EXECUTION_ERROR'], 'Auto Loader (schema evolution) + DLT expectations (data-quality gates); RCA/triage agent for residual')]}
AGENT = 'Agent candidate (long tail)'
SOLVED = 'Solved by best practices'
BANDS = ((20, 'chronic (20+ fails) -> remediate pipeline'), (5, 'recurring (5-19)    -> remediate pipeline'))
SPORADIC = 'sporadic (1-4)      -> genuine triage-agent surface'
WRAPPER = ('childpipelinefailed|pipeline execution failed|workload failed, see run output|notebookexecutionexception|workflowexception|see run output for '
 'details')
RUN_REFERENCE = '(?:/runs?/|runId[=/]|run_id[=/])(\\d{4,})'
NO_OUTPUT = '[get-output unavailable]'
NO_CHILD = '[child run unavailable]'
NO_RUN = '[run detail unavailable]'
REASONS = [('Cascading skip (upstream failed)',
  'was skipped because not all its dependencies|run result unavailable|all upstream tasks',
  'Not a root cause — a downstream task skipped after an upstream failure. Dedupe to the upstream error; a Lakeflow DAG surfaces the true failing '
  'node and skips re-running healthy downstream work'),
 ('Lakeflow/DLT pipeline error (nested)',
  'refer to the logs for this pipeline|pipeline.*page|dlt|delta live',
  'Job error only points to the pipeline — drill into the pipeline event log (Pipelines API / system.lakeflow pipeline tables) for the real cause; '
  'add DLT expectations so data issues quarantine instead of failing the pipeline'),
 ('Kernel / driver crash',
  'kernel is unresponsive|python kernel|fatal error',
  'Usually driver memory or an unstable all-purpose cluster — move to serverless / right-size; split the monolithic notebook into smaller DLT '
  'stages'),
 ('Serverless incompatibility',
  'not allowed on serverless|pyspark rdds|not_implemented',
  'Unsupported API on serverless (e.g. RDDs) — refactor to DataFrame/Spark SQL, or pin to classic compute via DABs until refactored'),
 ('Schema / object mismatch',
  'unresolved_column|cannot be resolved|cannot resolve|analysisexception|table_or_view_not_found|no_such_catalog|no such '
  'catalog|catalog.*not.*found|no such struct|incompatible|schema mismatch|schema',
  'Auto Loader schema inference + schemaEvolutionMode=addNewColumns; enforce with DLT expectations instead of failing the run; pin catalog/table '
  'refs in DABs'),
 ('Missing / late-arriving files',
  'no such file|path does not exist|filenotfound|file.*not.*found|does not exist',
  'Auto Loader incremental file discovery — no ADF path enumeration; late/out-of-order files picked up automatically'),
 ('Memory pressure / OOM',
  'outofmemory|java heap|gc overhead|out of memory|executor lost|oom',
  'Move to serverless / let Lakeflow size compute; split monolithic notebook into DLT stages'),
 ('Timeout',
  'timeout|timed out|deadline exceeded|exceeded .*time',
  'Serverless + Lakeflow Jobs automatic retries; decompose into incremental DLT tables so each run does less'),
 ('Data access / permissions',
  'permission|access denied|unauthorized|forbidden|403|operation not permitted',
  'UC external locations + service principals; ingest via Auto Loader on the governed path'),
 ('Monitoring / setup config',
  'experiment tag|mlflow.monitoring|sqlwarehouseid|is missing or empty|not configured',
  'Fix the setup config (e.g. set the Lakehouse Monitoring warehouse tag); manage it declaratively via DABs so it cannot drift'),
 ('Missing parameter / widget',
  'widget is required|widget .*required|no workflow found|parameter .*required|is required',
  'Required job parameter/widget or lookup missing — make parameters explicit in the DABs job definition instead of relying on ADF-passed values'),
 ('Null / type errors on dirty data',
  'nullpointer|null value|nonetype|none type|null in',
  'DLT expectations to quarantine/drop bad rows (EXPECT ... ON VIOLATION DROP) rather than crashing'),
 ('Missing dependency / library',
  'modulenotfound|importerror|no module named|cannot import|library install',
  'Pin dependencies via DABs / serverless environments; remove ad-hoc %pip / cluster-library installs'),
 ('Malformed / parse errors',
  'malformed|corrupt|badrecord|could not parse|parseexception',
  'Auto Loader rescued-data column captures bad records; add DLT expectations on parse quality'),
 ('Data quality / dedup',
  'constraint|duplicate|primary key|unique|merge .*match',
  'DLT expectations + APPLY CHANGES INTO (CDC) for idempotent, dedup-safe upserts'),
 ('Source connectivity (JDBC/API)',
  'connection|connect timed|refused|network|unknown host|jdbc|socket',
  'Lakeflow Connect managed connectors with built-in retry, replacing ADF copy activities'),
 ('Capacity / quota', 'instance pool|capacity|quota|limit exceeded', 'Serverless removes fixed pools/quotas; Lakeflow elasticity absorbs bursts'),
 ('Application code bug (unhandled exception)',
  'notimplementederror|not yet wired|typeerror|keyerror|valueerror|attributeerror|assertionerror|runtimeerror|exception',
  'Genuine code defect (unhandled exception) — this is the real RCA/triage-agent surface; route with the enriched stack trace for a fix suggestion')]
OTHER_REASON = 'Other / uncategorized code error'
OTHER_ADVICE = 'Route to the RCA/triage agent with the enriched error text + stack trace'
STORAGE_METRICS = ['total_bytes', 'active_bytes', 'vacuumable_bytes', 'time_travel_bytes']
PROPERTY_COLUMNS = {'delta_deletion_vectors': 'delta.enableDeletionVectors',
 'delta_auto_optimize': 'delta.autoOptimize.optimizeWrite',
 'delta_auto_compact': 'delta.autoOptimize.autoCompact',
 'delta_log_retention': 'delta.logRetentionDuration',
 'delta_deleted_file_retention': 'delta.deletedFileRetentionDuration',
 'delta_checkpoint_interval': 'delta.checkpointInterval',
 'delta_data_skipping_cols': 'delta.dataSkippingNumIndexedCols',
 'delta_append_only': 'delta.appendOnly',
 'delta_target_file_size': 'delta.targetFileSize',
 'delta_tune_file_sizes': 'delta.tuneFileSizesForRewrites'}
