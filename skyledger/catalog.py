"""The catalog of asset table views: ordered field lists per service.

``VIEWS["aws/ec2"]`` is a ``ViewSpec`` usable with ``views.table_view``;
``source`` names the asset file stem the view reads. Every view drops
removed rows (F1) and marks them with ``row_class`` (P12); the views' text
renderers are attached (P4-P6, P9) and state columns get badge classes via
``state_classes`` (P7). More renderers can be attached with ``with_renders``;
column titles come from ``titles``. ``REMOVED_VIEWS`` holds the column lists
of the removed assets of each provider's services.
"""

from __future__ import annotations

from dataclasses import replace

from skyledger.functions import render as R
from skyledger.operators.views import ViewColumn, ViewSpec
from skyledger.sources.readers import CatalogEntry
from skyledger.titles import removed_lists, view_titles

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# view key, asset file stem, projected fields in column order.
_VIEW_TABLE = """
alibaba/ack                  alibaba/ack                  account name cluster_id cluster_type kubernetes_version region_id node_count state status
alibaba/ecs                  alibaba/ecs                  account instance_name instance_id instance_type region_id zone_id public_ip private_ip cpu memory_gb status
alibaba/oss                  alibaba/oss                  account name location storage_class acl versioning creation_date status
alibaba/rds                  alibaba/rds                  account db_instance_description db_instance_id engine engine_version db_instance_class region_id db_instance_storage connection_string status
aws/acm                      aws/acm                      account domain_name arn region type validation_method in_use_by not_after cert_status status
aws/amplify                  aws/amplify                  account name app_id default_domain repository platform region status
aws/apigateway               aws/apigateway               account api_name api_id api_type endpoint region stages created_date status
aws/apprunner                aws/apprunner                account name service_arn service_url source_type cpu memory region service_status status
aws/appsync                  aws/appsync                  account name api_id api_type authentication_type graphql_endpoint region status
aws/athena                   aws/athena                   account name state output_location enforce_config region status
aws/backup                   aws/backup                   account name resource_type recovery_points encrypted region status
aws/batch                    aws/batch                    account name compute_type state max_vcpus service_role region status
aws/cloudfront               aws/cloudfront               account distribution_id domain_name aliases origin price_class ssl_certificate enabled status discovery_date
aws/cloudwatch               aws/cloudwatch               account alarm_name region metric_name namespace threshold state_value actions_enabled status
aws/codeartifact             aws/codeartifact             account name domain_name format upstreams region status
aws/codebuild                aws/codebuild                account name source_type compute_type image last_build_status region status
aws/codecommit               aws/codecommit               account name clone_url_http default_branch last_modified region status
aws/codedeploy               aws/codedeploy               account name compute_platform deployment_groups_count last_deployment region status
aws/codepipeline             aws/codepipeline             account name stage_count version region last_execution pipeline_state status
aws/cognito                  aws/cognito                  account pool_name pool_id region estimated_users mfa_configuration created_date status
aws/datasync                 aws/datasync                 account name task_arn source_location destination_location region task_status status
aws/documentdb               aws/documentdb               account cluster_id engine engine_version instance_class endpoint cluster_state region status
aws/dynamodb                 aws/dynamodb                 account table_name region partition_key sort_key billing_mode item_count size_mb gsi_count status discovery_date
aws/ec2                      aws/ec2                      account instance_id name instance_type state private_ip public_ip region status discovery_date
aws/ecr                      aws/ecr                      account repository_name repository_uri region image_count scan_on_push encryption_type created_date status
aws/ecs                      aws/ecs                      account cluster_name region running_tasks pending_tasks services_count container_instances capacity_providers status discovery_date
aws/efs                      aws/efs                      account name file_system_id size_gb performance_mode throughput_mode encrypted region status
aws/eks                      aws/eks                      account cluster_name version region endpoint node_groups vpc_id status discovery_date
aws/elasticache              aws/elasticache              account cluster_id engine engine_version node_type num_nodes region endpoint encryption_at_rest status discovery_date
aws/elasticbeanstalk         aws/elasticbeanstalk         account name application_name platform cname health region status
aws/elb                      aws/elb                      account name type dns_name scheme region az_count target_groups listeners status discovery_date
aws/emr                      aws/emr                      account name cluster_id release_label master_instance_type instance_count cluster_state region status
aws/eventbridge              aws/eventbridge              account rule_name event_bus region schedule_expression state target_count status
aws/fsx                      aws/fsx                      account name file_system_id file_system_type storage_capacity dns_name region status
aws/glue                     aws/glue                     account name job_type glue_version number_of_workers worker_type last_run region status
aws/iam                      aws/iam                      account user_name user_id created_date password_last_used mfa_enabled access_keys groups status discovery_date
aws/kinesis                  aws/kinesis                  account stream_name region shard_count stream_mode retention_hours encryption_type stream_status status
aws/kms                      aws/kms                      account key_id alias region key_type key_spec key_state created_date status
aws/lambda                   aws/lambda                   account function_name runtime handler memory_mb timeout_sec code_size_mb region vpc_config status last_modified
aws/lightsail                aws/lightsail                account name blueprint_id bundle_id public_ip state region status
aws/memorydb                 aws/memorydb                 account name node_type num_nodes engine_version endpoint cluster_state region status
aws/mq                       aws/mq                       account broker_name engine_type engine_version host_instance_type region deployment_mode broker_state status
aws/msk                      aws/msk                      account cluster_name kafka_version instance_type broker_count region storage_per_broker cluster_state status
aws/neptune                  aws/neptune                  account cluster_id engine engine_version instance_class endpoint cluster_state region status
aws/opensearch               aws/opensearch               account domain_name engine_version instance_type instance_count region endpoint encryption_at_rest status
aws/rds                      aws/rds                      account db_identifier engine engine_version instance_class storage_gb region multi_az encrypted status discovery_date
aws/redshift                 aws/redshift                 account cluster_id node_type number_of_nodes region db_name endpoint encrypted status
aws/s3                       aws/s3                       account bucket_name region created_date versioning encryption public_access size_gb object_count status
aws/sagemaker                aws/sagemaker                account name resource_type instance_type endpoint_name resource_state region status
aws/sns                      aws/sns                      account topic_name topic_arn region subscriptions_count topic_type encryption status discovery_date
aws/sqs                      aws/sqs                      account queue_name queue_type region messages_available messages_in_flight retention_days encryption status discovery_date
aws/stepfunctions            aws/stepfunctions            account name arn type region created_date status
aws/transfer                 aws/transfer                 account server_id endpoint_type protocols endpoint state region status
aws/vpc                      aws/vpc                      account vpc_id name cidr_block region subnet_count igw_attached nat_gateway_count is_default status
aws/waf                      aws/waf                      account name id scope region rule_count default_action associated_resources status
azure/ad-users               azure/ad_users               account display_name user_principal_name user_type department job_title created_date last_sign_in mfa_registered account_enabled status
azure/aks                    azure/aks                    account cluster_name resource_group location kubernetes_version node_pool_count total_nodes network_plugin power_state status
azure/apim                   azure/apim                   account name resource_group location sku gateway_url apis_count status
azure/appservice             azure/appservice             account app_name resource_group location kind default_hostname app_service_plan state https_only status
azure/cdn                    azure/cdn                    account profile_name resource_group sku endpoint_count custom_domains resource_state status
azure/cognitiveservices      azure/cognitiveservices      account name kind sku resource_group location endpoint status
azure/containerregistry      azure/containerregistry      account registry_name resource_group location sku login_server admin_enabled repository_count status
azure/cosmosdb               azure/cosmosdb               account account_name resource_group location database_api database_count read_locations consistency_level status
azure/databricks             azure/databricks             account name resource_group location sku workspace_url status
azure/datafactory            azure/datafactory            account name resource_group location pipelines_count datasets_count status
azure/devops                 azure/devops                 account name organization visibility repos_count pipelines_count last_activity status
azure/eventhub               azure/eventhub               account namespace_name resource_group location sku capacity eventhub_count kafka_enabled status
azure/frontdoor              azure/frontdoor              account name resource_group host_name routing_rules_count backend_pools_count waf_enabled status
azure/functions              azure/functions              account function_app_name resource_group location runtime_stack runtime_version plan_type function_count state status
azure/keyvault               azure/keyvault               account vault_name resource_group location sku secret_count key_count certificate_count soft_delete_enabled status
azure/loadbalancer           azure/loadbalancer           account name resource_group location sku lb_type frontend_ips status
azure/logicapps              azure/logicapps              account name resource_group location sku state status
azure/mlworkspace            azure/mlworkspace            account name resource_group location sku compute_instances status
azure/redis                  azure/redis                  account cache_name resource_group location sku capacity port ssl_port minimum_tls_version status
azure/servicebus             azure/servicebus             account namespace_name resource_group location sku queue_count topic_count endpoint status
azure/sql                    azure/sql                    account server_name database_name resource_group location edition service_tier max_size_gb fqdn status discovery_date
azure/storage                azure/storage                account account_name resource_group location sku kind access_tier https_only blob_containers file_shares status
azure/synapse                azure/synapse                account name resource_group location sql_pools_count spark_pools_count managed_vnet status
azure/vms                    azure/vms                    account vm_name resource_group vm_size os_type os_disk private_ip public_ip location power_state status
azure/vnet                   azure/vnet                   account name resource_group location address_space subnets_count peerings_count status
cloudflare/access            cloudflare/access            account name type domain account_id created status
cloudflare/d1                cloudflare/d1                account name version account_id created status
cloudflare/durable-objects   cloudflare/durable-objects   account name class account_id created status
cloudflare/images            cloudflare/images            account id filename account_id uploaded status
cloudflare/kv                cloudflare/kv                account title account_id created status
cloudflare/pages             cloudflare/pages             account name production_branch account_id created status
cloudflare/queues            cloudflare/queues            account name account_id created status
cloudflare/r2                cloudflare/r2                account name location account_id created status
cloudflare/stream            cloudflare/stream            account name duration account_id uploaded status
cloudflare/tunnels           cloudflare/tunnels           account name connections account_id created status
cloudflare/workers           cloudflare/workers           account name routes account_id created status
digitalocean/apps            digitalocean/apps            account name region live_url tier component_count created_date updated_date status
digitalocean/databases       digitalocean/databases       account name engine version size region num_nodes host port status
digitalocean/droplets        digitalocean/droplets        account name droplet_id size region image public_ip private_ip vcpus memory_gb status
digitalocean/kubernetes      digitalocean/kubernetes      account name region version node_pool_count total_nodes endpoint created_date status
digitalocean/spaces          digitalocean/spaces          account name region endpoint cdn_enabled created_date status
dns/domains                  domains                      domain status registrar expiry_date discovery_date last_seen
dns/subdomains               subdomains                   domain subdomain type data source status discovery_date
gcp/artifactregistry         gcp/artifactregistry         account name format location size_gb project status
gcp/bigquery                 gcp/bigquery                 account dataset_id project location table_count view_count default_table_expiration created_date status
gcp/bigtable                 gcp/bigtable                 account instance_name instance_type cluster_count table_count total_nodes project state status
gcp/cloudbuild               gcp/cloudbuild               account name source_type repository branch_pattern project status
gcp/cloudrun                 gcp/cloudrun                 account service_name region url image memory cpu max_instances project status
gcp/cloudscheduler           gcp/cloudscheduler           account name schedule target_type state location project status
gcp/cloudsql                 gcp/cloudsql                 account instance_name database_version tier region storage_gb storage_type public_ip private_ip high_availability backup_enabled project status
gcp/cloudtasks               gcp/cloudtasks               account name state location rate_limit project status
gcp/composer                 gcp/composer                 account name state airflow_version region airflow_uri project status
gcp/compute                  gcp/compute                  account instance_name machine_type zone internal_ip external_ip network project os power_state status
gcp/dataflow                 gcp/dataflow                 account name job_id job_type current_state region project status
gcp/dataproc                 gcp/dataproc                 account name state zone master_type num_workers project status
gcp/functions                gcp/functions                account function_name region runtime entry_point memory_mb timeout_sec trigger_type project status
gcp/gcs                      gcp/gcs                      account bucket_name location storage_class created_date public_access versioning lifecycle_rules project status
gcp/gke                      gcp/gke                      account cluster_name location cluster_mode master_version node_pool_count total_nodes network project status
gcp/iam                      gcp/iam                      account email display_name created_date key_count last_key_used disabled project roles status
gcp/loadbalancing            gcp/loadbalancing            account name lb_type scheme ip_address protocol port_range backend_count project status
gcp/memorystore              gcp/memorystore              account instance_name instance_type region tier memory_size_gb redis_version project state status
gcp/pubsub                   gcp/pubsub                   account topic_name project subscription_count kms_key_name message_retention created_date status
gcp/spanner                  gcp/spanner                  account instance_name config node_count processing_units database_count project state status
gcp/vertexai                 gcp/vertexai                 account name resource_type region state project status
oracle/compute               oracle/compute               account display_name shape region availability_domain public_ip private_ip ocpus memory_gb lifecycle_state status
oracle/database              oracle/database              account display_name db_type db_version region ocpus storage_tb workload_type lifecycle_state status
oracle/objectstorage         oracle/objectstorage         account name namespace region storage_tier versioning public_access_type created_date status
oracle/oke                   oracle/oke                   account name kubernetes_version region vcn_id node_pool_count lifecycle_state status
"""
# ---------------------------------------------------------------------------


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Cell text renderers of the views: view, field, renderer and its arguments.
#   bool YES|NO      -> YES when the value is truthy, else NO
#   or TEXT          -> the value when truthy, else TEXT
#   list / list-null -> items joined by ', '; '-' when null or empty / only when null
#   unit SUFFIX|ELSE -> value followed by SUFFIX when truthy, else ELSE
_RENDER_TABLE = """
alibaba/oss versioning bool Enabled|Disabled
aws/apigateway stages list-null
aws/cloudfront aliases list
aws/cloudfront enabled bool Yes|No
aws/cloudwatch actions_enabled bool Yes|No
aws/dynamodb sort_key or -
aws/ec2 public_ip or -
aws/ecr scan_on_push bool Yes|No
aws/ecs capacity_providers list-null
aws/elasticache encryption_at_rest bool Yes|No
aws/eventbridge schedule_expression or Event Pattern
aws/iam password_last_used or Never
aws/iam mfa_enabled bool Enabled|Disabled
aws/iam groups list
aws/kinesis encryption_type or None
aws/lambda vpc_config bool Yes|No
aws/opensearch encryption_at_rest bool Yes|No
aws/rds multi_az bool Yes|No
aws/rds encrypted bool Yes|No
aws/redshift encrypted bool Yes|No
aws/s3 versioning bool Enabled|Disabled
aws/s3 encryption or None
aws/s3 public_access bool Public|Private
aws/sns encryption or None
aws/sqs encryption or None
aws/vpc igw_attached bool Yes|No
aws/vpc is_default bool Yes|No
azure/ad-users department or -
azure/ad-users job_title or -
azure/ad-users last_sign_in or Never
azure/ad-users mfa_registered bool Registered|Not Registered
azure/ad-users account_enabled bool Yes|No
azure/appservice https_only bool Yes|No
azure/containerregistry admin_enabled bool Yes|No
azure/eventhub kafka_enabled bool Yes|No
azure/keyvault soft_delete_enabled bool Yes|No
azure/storage access_tier or -
azure/storage https_only bool Yes|No
azure/vms public_ip or -
digitalocean/spaces cdn_enabled bool Yes|No
gcp/bigquery default_table_expiration unit ms|Never
gcp/cloudsql public_ip or -
gcp/cloudsql private_ip or -
gcp/cloudsql high_availability bool Yes|No
gcp/cloudsql backup_enabled bool Yes|No
gcp/compute external_ip or -
gcp/gcs public_access bool Public|Private
gcp/gcs versioning bool Enabled|Disabled
gcp/iam last_key_used or Never
gcp/iam disabled bool Yes|No
gcp/iam roles list
gcp/pubsub kms_key_name bool CMEK|Google-managed
oracle/objectstorage versioning bool Enabled|Disabled
"""
# Badge class of state columns (the text stays the value): view, field, mapping.
_STATE_TABLE = """
aws/cloudwatch state_value alarm
aws/ec2 state ec2
azure/vms power_state azure
gcp/compute power_state gcp
"""
# ---------------------------------------------------------------------------

_STATE_MAPPINGS = {"alarm": R.ALARM_STATE_CLASS, "ec2": R.EC2_STATE_CLASS, "azure": R.AZURE_POWER_CLASS,
                   "gcp": R.GCP_POWER_CLASS}


def _renderer(kind: str, arg: str):
    if kind == "bool":
        yes, no = arg.split("|")
        return lambda df, f: R.bool_label(df, f, yes, no)
    if kind == "or":
        return lambda df, f: R.or_default(df, f, arg)
    if kind == "list":
        return lambda df, f: R.list_label(df, f, True)
    if kind == "list-null":
        return lambda df, f: R.list_label(df, f, False)
    if kind == "unit":
        suffix, otherwise = arg.split("|")
        return lambda df, f: R.with_unit(df, f, suffix, otherwise)
    raise ValueError(kind)


def _renders() -> dict[str, dict]:
    out: dict[str, dict] = {}
    for line in _RENDER_TABLE.strip().splitlines():
        view, field, kind, *arg = line.split()
        out.setdefault(view, {})[field] = _renderer(kind, " ".join(arg))
    return out


def _parse() -> dict[str, ViewSpec]:
    renders = _renders()
    out = {}
    for line in _VIEW_TABLE.strip().splitlines():
        key, source, *fields = line.split()
        out[key] = ViewSpec.of(key, " ".join(fields), source=source, titles=view_titles(key, fields), renders=renders.get(key))
    return out


VIEWS: dict[str, ViewSpec] = _parse()
# the removed-service lists: provider to service to its columns; ``source`` names the asset file stem
REMOVED_VIEWS: dict[str, dict[str, ViewSpec]] = {
    provider: {service: ViewSpec.of(f"{provider}/{service}", " ".join(columns), titles=columns,
                                    source=service if provider == "dns" else f"{provider}/{service}")
               for service, columns in services.items()}
    for provider, services in removed_lists().items()}
STATE_CLASSES: dict[str, dict] = {}
for _line in _STATE_TABLE.strip().splitlines():
    _v, _f, _m = _line.split()
    STATE_CLASSES.setdefault(_v, {})[_f] = _STATE_MAPPINGS[_m]


def state_classes(df, view_key: str) -> list:
    """Badge-class columns (``<field>_class``) of a view's state fields."""
    return [R.state_class(df, f, m).alias(f"{f}_class") for f, m in STATE_CLASSES.get(view_key, {}).items()]


def with_renders(view: ViewSpec, renders: dict) -> ViewSpec:
    """A copy of ``view`` whose named fields use the given renderers
    (``(df, field) -> Column``)."""
    cols = tuple(ViewColumn(c.title, c.data, renders.get(c.data, c.render)) for c in view.columns)
    return replace(view, columns=cols)


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Global search sources: provider, service, name field, service label.
# Provider labels: DNS, AWS, Azure, GCP, Cloudflare, DigitalOcean, Oracle, Alibaba.
_SEARCH_TABLE = """
dns domains domain Domains
dns subdomains subdomain Subdomains
aws ec2 name EC2 Instances
aws eks cluster_name EKS Clusters
aws ecs cluster_name ECS Clusters
aws lambda function_name Lambda Functions
aws rds db_identifier RDS Databases
aws dynamodb table_name DynamoDB Tables
aws s3 bucket_name S3 Buckets
aws iam user_name IAM Users
aws vpc vpc_name VPCs
aws elb name Load Balancers
aws cloudfront domain_name CloudFront
aws sqs queue_name SQS Queues
aws sns topic_name SNS Topics
azure vms vm_name Virtual Machines
azure aks cluster_name AKS Clusters
azure appservice app_name App Service
azure functions function_name Functions
azure sql database_name SQL Databases
azure storage storage_name Storage Accounts
azure keyvault vault_name Key Vault
gcp compute instance_name Compute Instances
gcp gke cluster_name GKE Clusters
gcp cloudrun service_name Cloud Run
gcp functions function_name Cloud Functions
gcp cloudsql instance_name Cloud SQL
gcp gcs bucket_name Cloud Storage
gcp pubsub topic_name Pub/Sub
cloudflare workers worker_name Workers
cloudflare pages project_name Pages
cloudflare r2 bucket_name R2 Storage
cloudflare kv namespace_name KV Namespaces
cloudflare d1 database_name D1 Databases
cloudflare tunnels tunnel_name Tunnels
digitalocean droplets droplet_name Droplets
digitalocean kubernetes cluster_name Kubernetes
digitalocean apps app_name App Platform
digitalocean databases db_name Databases
digitalocean spaces space_name Spaces
oracle compute instance_name Compute Instances
oracle oke cluster_name OKE Clusters
oracle database db_name Databases
oracle objectstorage bucket_name Object Storage
alibaba ecs instance_name ECS Instances
alibaba ack cluster_name ACK Clusters
alibaba rds db_name RDS Databases
alibaba oss bucket_name OSS Buckets
"""
# ---------------------------------------------------------------------------


def search_manifest(base_dir: str) -> list[CatalogEntry]:
    """The global-search catalog over asset files under ``base_dir``: DNS
    files sit at the top (``domains.json``), others under their provider
    (``aws/ec2.json``); the result page is the service's view."""
    out = []
    for line in _SEARCH_TABLE.strip().splitlines():
        provider, service, name_field, *label = line.split()
        stem = service if provider == "dns" else f"{provider}/{service}"
        out.append(CatalogEntry(provider, service, f"{base_dir.rstrip('/')}/{stem}.json", " ".join(label),
                                f"{provider}/{service}.html", name_field))
    return out
