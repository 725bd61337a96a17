"""Column titles of the views and of the removed-service lists.

A title is made from the field's words: known words have their spelling, a
trailing count names what is counted, a trailing unit stands in brackets. Fields
and views that are titled otherwise are listed.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for equal results).
# Words with a spelling of their own.
_WORDS = dict(line.split(None, 1) for line in """
acl ACL
api API
apis APIs
arn ARN
az AZ
cdn CDN
cidr CIDR
cpu CPU
db DB
dns DNS
eventhub Event Hub
fqdn FQDN
gsi GSI
https HTTPS
id ID
ip IP
ips IPs
nat NAT
ocpus OCPUs
on on
os OS
sku SKU
sql SQL
ssl SSL
uri URI
url URL
vcpus vCPUs
vm VM
vnet VNet
vpc VPC
waf WAF
""".strip().splitlines())
# Units at the end of a field.
_UNITS = {"gb": "GB", "mb": "MB", "tb": "TB", "sec": "s", "hours": "hrs", "days": "days"}
# Fields with a title of their own.
_FIELD_TITLES = dict(line.split(None, 1) for line in """
account_enabled Enabled
application_name Application
authentication_type Authentication
availability_domain AD
backend_count Backend Services
backup_enabled Backup
blob_containers Containers
blueprint_id Blueprint
branch_pattern Branch
bundle_id Bundle
clone_url_http Clone URL
cluster_mode Mode
cluster_state State
cname URL
consistency_level Consistency
created_at Created
created_date Created
creation_date Created
current_state State
current_version Version
database_api API
db_instance_class Class
db_instance_description Instance Name
db_instance_id Instance ID
db_instance_storage Storage (GB)
db_name Database
db_type Type
db_version Version
db_workload Workload
default_table_expiration Default Expiration
destination_location Destination
droplet_id ID
duration Duration (s)
encryption_at_rest Encryption
encryption_type Encryption
endpoint_name Endpoint
engine_type Engine
estimated_users Users
file_system_type Type
function_app_name Function App
graphql_endpoint Endpoint
high_availability HA
host_instance_type Instance Type
igw_attached Internet Gateway
image_count Image Count
is_default Default
job_type Type
kms_key_name Encryption
kubernetes_version K8s Version
last_build_status Last Build
last_sign_in Last Sign-In
lb_type Type
master_instance_type Instance Type
memory_size_gb Memory (GB)
metric_name Metric
mfa_configuration MFA
mfa_enabled MFA
mfa_registered MFA
minimum_tls_version TLS Version
multi_az Multi-AZ
namespace_name Namespace
node_count Node Count
not_after Expires
num_nodes Nodes
num_workers Workers
number_of_nodes Nodes
number_of_workers Workers
os_type OS
password_last_used Last Used
project_count Project Count
public_access_type Public Access
read_locations Read Regions
redis_version Version
region_id Region
release_label Release
repository_uri URI
resource_state State
resource_type Type
runtime_stack Runtime
runtime_version Version
schedule_expression Schedule
service_type Service
soft_delete_enabled Soft Delete
source_location Source
source_type Source
state_value State
storage_capacity Storage (GB)
storage_per_broker Storage (GB)
stream_mode Mode
target_type Target
tier_slug Tier
title Namespace Title
trigger_type Trigger
updated_date Updated
user_principal_name UPN
validation_method Validation
vcn_id VCN
vm_size Size
vpc_config VPC
waf_enabled WAF
workload_type Workload
workspace_url URL
zone_id Zone
""".strip().splitlines())
# Views that title a field otherwise: view, field, title.
_VIEW_TITLES = """
alibaba/ack name Cluster Name
alibaba/ecs cpu vCPUs
alibaba/oss location Region
alibaba/oss name Bucket Name
alibaba/rds engine_version Version
aws/amplify name App Name
aws/apigateway api_type Type
aws/apprunner name Service Name
aws/apprunner source_type Source Type
aws/appsync name API Name
aws/athena name Workgroup
aws/backup name Vault Name
aws/batch compute_type Type
aws/batch name Compute Env
aws/codeartifact domain_name Domain
aws/codeartifact name Repository Name
aws/codebuild name Project Name
aws/codecommit name Repository Name
aws/codedeploy name Application Name
aws/codepipeline name Pipeline Name
aws/datasync name Task Name
aws/ec2 instance_type Type
aws/efs name File System Name
aws/elasticbeanstalk name Environment
aws/emr instance_count Instances
aws/emr name Cluster Name
aws/fsx name File System Name
aws/glue name Job Name
aws/lightsail name Instance Name
aws/memorydb name Cluster Name
aws/msk cluster_state Cluster State
aws/opensearch instance_count Instance Count
aws/rds engine_version Version
aws/sagemaker name Resource Name
aws/stepfunctions name State Machine
aws/waf name Web ACL Name
azure/databricks name Workspace Name
azure/devops name Project Name
azure/mlworkspace name Workspace Name
azure/synapse name Workspace Name
cloudflare/access name App Name
cloudflare/d1 name Database Name
cloudflare/images id Image ID
cloudflare/pages name Project Name
cloudflare/queues name Queue Name
cloudflare/r2 name Bucket Name
cloudflare/stream name Video Name
cloudflare/tunnels name Tunnel Name
cloudflare/workers name Worker Name
digitalocean/apps name App Name
digitalocean/droplets vcpus VCPUs
digitalocean/kubernetes name Cluster Name
gcp/artifactregistry name Repository Name
gcp/cloudbuild name Trigger Name
gcp/cloudscheduler name Job Name
gcp/cloudtasks name Queue Name
gcp/composer name Environment Name
gcp/dataflow name Job Name
gcp/dataproc name Cluster Name
gcp/memorystore instance_type Type
gcp/vertexai name Resource Name
oracle/compute display_name Instance Name
oracle/database display_name DB Name
oracle/objectstorage name Bucket Name
oracle/oke name Cluster Name
"""
# Removed-service lists: provider, service, fields between account (where the
# provider has accounts) and removed_date; each ends in removed_date and status.
_REMOVED_TABLE = """
alibaba ecs instance_id instance_name instance_type region_id
alibaba ack cluster_id name current_version region_id
alibaba rds db_instance_id db_instance_description engine region_id
alibaba oss name location creation_date
azure vms name size resource_group location
azure aks name kubernetes_version resource_group location
azure appservice name kind resource_group location
azure functions name runtime resource_group location
azure sql name server_name resource_group location
azure cosmosdb name api_type resource_group location
azure redis name sku resource_group location
azure storage name kind resource_group location
azure containerregistry name sku resource_group location
azure ad_users display_name email department
azure keyvault name resource_group location
azure cdn name sku resource_group
azure frontdoor name resource_group frontend_hosts
azure loadbalancer name sku resource_group location
azure vnet name address_space resource_group location
azure apim name sku resource_group location
azure servicebus name sku resource_group location
azure eventhub name sku resource_group location
azure logicapps name state resource_group location
azure datafactory name resource_group location
azure synapse name resource_group location
azure databricks name sku resource_group location
azure mlworkspace name sku resource_group location
azure cognitiveservices name kind sku resource_group location
azure devops name project_count
cloudflare workers name routes created
cloudflare pages name production_branch created
cloudflare r2 name location created
cloudflare kv title created
cloudflare d1 name version created
cloudflare queues name created
cloudflare durable-objects name class created
cloudflare images id filename uploaded
cloudflare stream name duration created
cloudflare tunnels name connections created
cloudflare access name type domain
digitalocean droplets name size region public_ip vcpus
digitalocean kubernetes name version region node_count
digitalocean apps spec_name region tier_slug
digitalocean databases name engine size region
digitalocean spaces name region created_at
dns domains domain registrar expiration
dns subdomains subdomain type value source
gcp compute name machine_type zone project
gcp gke name master_version location project
gcp cloudrun name region project
gcp functions name runtime region project
gcp cloudsql name database_version region project
gcp bigquery dataset_id location project
gcp bigtable name cluster_count project
gcp spanner name config node_count project
gcp memorystore name tier region project
gcp gcs name location storage_class project
gcp artifactregistry name format location project
gcp iam email display_name project
gcp secretmanager name project
gcp loadbalancing name type project
gcp pubsub name project
gcp cloudtasks name location project
gcp cloudscheduler name schedule location project
gcp dataflow name type region project
gcp dataproc name region project
gcp vertexai name region project
gcp composer name region project
gcp cloudbuild name project
oracle compute display_name shape region availability_domain
oracle oke name kubernetes_version region node_pool_count
oracle database db_name db_version db_workload region
oracle objectstorage name namespace region storage_tier
"""
NO_ACCOUNT = ("dns",)
# Removed-service lists that title a field otherwise: list, field, title.
_REMOVED_TITLES = """
alibaba/ecs instance_name Name
alibaba/ecs instance_type Type
alibaba/oss name Bucket Name
alibaba/rds db_instance_description Name
azure/aks kubernetes_version Version
azure/aks name Cluster Name
azure/cdn name Profile Name
azure/cosmosdb api_type API
azure/cosmosdb name Account Name
azure/databricks name Workspace Name
azure/devops name Organization
azure/eventhub name Namespace
azure/mlworkspace name Workspace Name
azure/servicebus name Namespace
azure/sql server_name Server
azure/synapse name Workspace Name
cloudflare/kv title Title
cloudflare/r2 name Bucket Name
cloudflare/stream duration Duration
digitalocean/apps spec_name Name
gcp/artifactregistry name Repository
gcp/bigquery dataset_id Dataset
gcp/bigtable cluster_count Cluster Count
gcp/bigtable name Instance Name
gcp/cloudbuild name Trigger Name
gcp/cloudrun name Service Name
gcp/cloudscheduler name Job Name
gcp/cloudsql name Instance Name
gcp/cloudtasks name Queue Name
gcp/composer name Environment Name
gcp/dataflow name Job Name
gcp/dataproc name Cluster Name
gcp/functions name Function Name
gcp/gcs name Bucket Name
gcp/gke master_version Version
gcp/gke name Cluster Name
gcp/memorystore name Instance Name
gcp/pubsub name Topic Name
gcp/secretmanager name Secret Name
gcp/spanner name Instance Name
gcp/vertexai name Endpoint Name
oracle/compute availability_domain Availability Domain
oracle/compute display_name Name
oracle/database db_name Name
oracle/database db_version DB Version
oracle/oke kubernetes_version Version
"""
# ---------------------------------------------------------------------------


def _plural(text: str) -> str:
    if text.endswith("s") and not text.endswith("ss"):
        return text
    return text[:-1] + "ies" if text.endswith("y") and text[-2] not in "aeiou" else text + "s"


def title_of(field: str) -> str:
    """The title of a field where its view names no other."""
    if field in _FIELD_TITLES:
        return _FIELD_TITLES[field]
    words = field.split("_")
    counted, unit = len(words) > 1 and words[-1] == "count", _UNITS.get(words[-1]) if len(words) > 1 else None
    if counted or unit:
        words = words[:-1]
    text = " ".join(_WORDS.get(w, w.capitalize()) for w in words)
    text = text[0].upper() + text[1:] if words[0] not in _WORDS else text
    return _plural(text) if counted else f"{text} ({unit})" if unit else text


def _own(table: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for line in table.strip().splitlines():
        key, field, title = line.split(None, 2)
        out.setdefault(key, {})[field] = title
    return out


_VIEWS, _REMOVED = _own(_VIEW_TITLES), _own(_REMOVED_TITLES)


def view_titles(key: str, fields: list[str]) -> dict[str, str]:
    """Field to title of a view (``aws/ec2``)."""
    return {f: _VIEWS.get(key, {}).get(f) or title_of(f) for f in fields}


def removed_lists() -> dict[str, dict[str, dict[str, str]]]:
    """Provider to service to its removed list: field to title, in column order."""
    out: dict[str, dict[str, dict[str, str]]] = {}
    for line in _REMOVED_TABLE.strip().splitlines():
        provider, service, *fields = line.split()
        fields = ([] if provider in NO_ACCOUNT else ["account"]) + fields + ["removed_date", "status"]
        own = _REMOVED.get(f"{provider}/{service}", {})
        out.setdefault(provider, {})[service] = {f: own.get(f) or title_of(f) for f in fields}
    return out
