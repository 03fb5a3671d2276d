"""Extraction and building over a small project of every kind of file."""

from pyspark.sql import functions as F


def edges_of(built):
    return {(r.source, r.relation, r.target) for r in built[0].edges.collect()}


def test_classes(built):
    graph, _ = built
    e = edges_of(built)
    assert {("apex_orderservice", "extends", "apex_baseservice"), ("apex_orderservice", "implements", "apex_sorter"), ("apex_orderservice", "implements", "apex_runnable")} <= e
    assert ("apex_orderservice", "implements", "apex_string") not in e
    assert {("apex_orderservice", "publishes", "object_shipped__e"), ("apex_orderservice", "reads_config", "object_config__c"), ("apex_orderservice", "invokes", "flow_approve_order")} <= e
    ops = {(r.target, r.operation) for r in graph.edges.where("relation = 'dml'").collect()}
    assert ops == {("object_order__c", "create"), ("object_account", "update")}, "comments and strings are no code; each method has its own variables"
    m = graph.nodes.where("id = 'method_orderservice_count'").first()
    assert m.label == "OrderService.count()" and m.line == 10 and m.sf_type == "ApexMethod"


def test_calls_resolve_by_what_is_known(built):
    got = {(r.source, r.target): (r.confidence, r.confidence_score) for r in built[0].edges.where("relation = 'calls'").collect()}
    assert got["method_orderservice_save", "method_helper_log"] == ("EXTRACTED", 1.0)
    assert got["method_orderservice_save", "apex_helper"] == ("INFERRED", 0.75)
    assert got["method_orderservice_count", "apex_unknown"] == ("INFERRED", 0.5)
    assert got["trigger_ordertrigger", "method_helper_log"] == ("EXTRACTED", 1.0)


def test_flow_and_parallel_edges(built):
    e = built[0].edges.where("source = 'flow_approve_order'")
    rows = {(r.relation, r.target, r.operation, r.key) for r in e.collect()}
    assert ("triggers", "object_order__c", "RecordAfterSave:Create", 0) in rows
    assert {r[2] for r in rows if r[1] == "object_account"} == {"read", "update"} and {r[3] for r in rows if r[1] == "object_account"} == {0, 1}
    kinds = {r.id: r.sf_type for r in built[0].nodes.where("file_type = 'flow'").collect()}
    assert kinds["flow_legacy"] == "ProcessBuilder" and kinds["flowelement_approve_order_big"] == "FlowDecision" and "flow_bad" not in kinds


def test_objects_fields_and_formulas(built):
    graph, _ = built
    e = edges_of(built)
    types = {r.id: (r.sf_type, r.attrs) for r in graph.nodes.where("id like 'object_%'").collect()}
    assert types["object_rates__x"][0] == "ExternalObject" and types["object_config__c"][0] == "CustomSetting" and types["object_shipped__e"][0] == "PlatformEvent"
    assert types["object_order__c"][1]["sharing_model"] == "Private"
    assert {("field_order__c_buyer__c", "references", "object_account"), ("field_order__c_status__c", "uses", "globalvalueset_stages"), ("object_order__c", "references", "object_account")} <= e
    formula = {(r.target, r.weight, r.confidence) for r in graph.edges.where("source = 'validationrule_order__c_sane'").collect()}
    # targets that no file defines and that aren't stubs don't survive the build
    assert all(c == "INFERRED" for _, _, c in formula)


def test_every_kind_gives_its_node(built):
    want = "globalvalueset_stages layout_order__c_main_layout profile_admin permset_clerk permset_all workflow_order__c workflowtask_order__c_t1 approvalprocess_order__c_big escalationrules_case label_hello namedcredential_billing externalservice_bank flexipage_home remotesitesetting_out csptrustedsite_cdn quickaction_new customtab_orders customapplication_shop settings_case criteriasharingrule_order__c_tosales duplicaterule_account_same matchingrule_account_fuzzy restrictionrule_only report_sales dashboard_top reporttype_orders installedpackage_ext bot_agent botversion_agent_v1 genaiplugin_topic genaifunction_act genaiplanner_plan genaifunction_local_plan_do prompttemplate_mail lwc_ordercard lwcmethod_ordercard_connectedcallback aura_oldcard auramethod_oldcard_run page_orders vfcomponent_box".split()
    assert set(want) <= {r.id for r in built[0].nodes.select("id").collect()}


def test_security(built):
    e = {(r.target, r.weight) for r in built[0].edges.where("source = 'profile_admin' and relation = 'grants'").collect()}
    assert {("object_order__c", 0.5), ("field_order__c_status__c", 0.3), ("app_shop", 0.5), ("customtab_orders", 0.5)} <= e and ("app_hidden", 0.5) not in e
    attrs = built[0].nodes.where("id = 'profile_admin'").first().attrs
    assert attrs["user_permissions"] == "ApiEnabled"


def test_documents(built):
    rows = built[0].edges.join(built[0].nodes.select(F.col("id").alias("source"), "sf_type", "label"), "source").where("sf_type = 'Document'").collect()
    to = {r.target: r for r in rows}
    # each name is its class and, up to the last dot, its methods: several candidates, at two thirds of the score
    assert to["apex_orderservice"].confidence_score == 0.4 and to["apex_helper"].confidence_score == 0.5
    heads = built[0].nodes.where("sf_type = 'DocumentSection'").orderBy("line").collect()
    assert [(r.label, r.line) for r in heads] == [("Orders", 1), ("Details", 5)]
    assert built[0].nodes.where("file_type = 'image'").count() == 1


def test_ignored_and_skipped_files(built):
    ids = {r.id for r in built[0].nodes.select("id").collect()}
    assert "apex_kept" in ids and not {"apex_gone", "apex_skipped"} & ids


def test_graph_is_sound(built):
    g, _ = built
    assert g.nodes.count() == g.nodes.select("id").distinct().count() == g.members.count() == g.members.select("id").distinct().count()
    ids = g.nodes.select("id")
    assert g.edges.join(ids, F.col("source") == F.col("id"), "left_anti").isEmpty() and g.edges.join(ids, F.col("target") == F.col("id"), "left_anti").isEmpty()
    assert g.edges.groupBy("source", "target", "key").count().where("count > 1").isEmpty()
    sizes = [r["count"] for r in g.members.groupBy("community").count().orderBy("community").collect()]
    assert sizes == sorted(sizes, reverse=True)


def tree_of_one_partition(spark, path, text):
    from pyspark.sql import functions as F

    from weftgraph.sources import files as tree

    files = spark.range(64, numPartitions=1).select(F.format_string(path, "id").alias("path"), F.lit(text).cast("binary").alias("content"))
    return files.withColumn("kind", tree.kind_of("path"))


def test_classes_are_scanned_once_in_several_tasks(spark):
    """Nodes, edges and calls each scanned every file again, in one task where the table had one split."""
    from weftgraph.extract import extract

    got = extract(tree_of_one_partition(spark, "/p/classes/C%d.cls", "public class C { void run() { Helper.log(1); } }"))
    assert got.nodes.count() > 0 and "MapInArrow" not in got.nodes._jdf.queryExecution().toString()
    assert len([f for f in got.nodes.inputFiles() if "/cut-" in f]) > 1


def test_objects_are_parsed_in_several_tasks(spark):
    from weftgraph.extract import extract

    got = extract(tree_of_one_partition(spark, "/p/objects/O%d__c/O%d__c.object-meta.xml".replace("O%d__c/", "X/", 1), "<CustomObject><label>S</label></CustomObject>"))
    assert got.nodes.count() == 64 and len([f for f in got.nodes.inputFiles() if "fragments" in f]) > 1
